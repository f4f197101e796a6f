"""Rules of commands as rows: which node types install packages, which read and make files."""

#: Install rules in their order: name, command types, types of the children that list packages (fixed values).
INSTALL = [
    ("apk", ["SC-APK-ADD"], ["SC-APK-PACKAGES"]),
    ("apt", ["SC-APT-INSTALL"], ["SC-APT-PACKAGES"]),
    ("apt-get", ["SC-APT-GET-INSTALL"], ["SC-APT-GET-PACKAGES"]),
    ("gem", ["SC-GEM-INSTALL"], ["SC-GEM-GEMS"]),
    ("go", ["SC-GO-GET", "SC-GO-INSTALL"], ["SC-GO-PACKAGES"]),
    ("npm", ["SC-NPM-INSTALL"], ["SC-NPM-PACKAGES"]),
    ("pip", ["SC-PIP-INSTALL"], ["SC-PIP-TARGETS"]),
    ("yarn", ["SC-YARN-INSTALL"], ["SC-YARN-MODULES"]),
    ("yum", ["SC-YUM-INSTALL"], ["SC-YUM-PACKAGES"]),
]
#: File rules in their order: name, command types, several files, last path is the target, then the types of
#: children that hold sources, targets and paths (fixed values).
FILES = [
    ("curl", ["SC-CURL"], False, False, ["SC-CURL-URL"], ["SC-CURL-OUTPUT"], []),
    ("git", ["SC-GIT-CLONE"], False, False, ["SC-GIT-URL"], ["SC-GIT-DIRECTORY"], []),
    ("wget", ["SC-WGET"], False, False, ["SC-WGET-URL"], ["SC-WGET-OUTPUT"], []),
    ("mkdir", ["SC-MKDIR"], True, True, [], [], ["SC-MKDIR-PATHS"]),
    ("mv", ["SC-MV"], True, True, [], ["SC-MV-DESTINATION"], ["SC-MV-PATHS"]),
    ("cp", ["SC-CP"], True, True, ["SC-CP-SOURCE"], ["SC-CP-DESTINATION", "SC-CP-DEST"], ["SC-CP-PATHS"]),
    ("tar", ["SC-TAR"], False, False, ["SC-TAR-FILE", "SC-TAR-F"], ["SC-TAR-OUTPUT"], []),
    ("unzip", ["SC-UNZIP"], False, False, ["SC-UNZIP-FILE", "SC-UNZIP-E"], ["SC-UNZIP-D"], []),
]


def install_rules(spark, rules=INSTALL):
    """cmd, part: a row for each type that lists packages below a command type."""
    return spark.createDataFrame([(c, p) for _, cmds, parts in rules for c in cmds for p in parts], "cmd string, part string").distinct()


def file_rules(spark, rules=FILES):
    """cmd, multi, last, roles: the first rule of each command type; roles maps a child's type to what it holds,
    sources before targets before paths."""
    rows, seen = [], set()
    for _, cmds, multi, last, source, target, path in rules:
        roles = {t: role for role, types in (("path", path), ("target", target), ("source", source)) for t in types}
        rows += [(c, multi, last, roles) for c in cmds if c not in seen]
        seen.update(cmds)
    return spark.createDataFrame(rows, "cmd string, multi boolean, last boolean, roles map<string,string>")


def grammar_names(spark, grammar):
    """command, prefix, name: a row for each scenario of a grammar {command: (prefix, scenarios, options)}."""
    return spark.createDataFrame([(c, p, s[1]) for c, (p, scenarios, _) in grammar.items() for s in scenarios], "command string, prefix string, name string").distinct()
