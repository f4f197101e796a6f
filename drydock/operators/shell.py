"""Shell semantics of build files: command grammar, folding, splitting of single trees.

Small helpers that run over one tree in an Arrow batch (tree.mapped_trees). What looks across instructions works on
node tables: rules, files and dependencies in `buildgraph`, variables in `symbols`.
"""
import re

from . import tree as T

#: command -> prefix and scenarios (template, name, must); a template names sub-commands, <one> and
#: [many...] positionals. Options by kind, names with their aliases (fixed values).
_INSTALL = "-y, --yes; -f, --fix-broken; -m, --ignore-missing; --fix-missing; --allow-unauthenticated; --no-install-recommends; --purge; --auto-remove; --autoremove; --force-yes; -d, --download-only; --assume-yes; --reinstall; --no-upgrade; --only-upgrade; -s, --simulate; -u, --show-upgraded"
GRAMMAR = {
    "apt-get": ("SC-APT-GET", [("$0 install [packages...]", "SC-APT-GET-INSTALL", ""), ("$0 purge [packages...]", "SC-APT-GET-PURGE", ""), ("$0 remove [packages...]", "SC-APT-GET-REMOVE", ""), ("$0 update", "SC-APT-GET-UPDATE", ""), ("$0 upgrade", "SC-APT-GET-UPGRADE", ""), ("$0 clean", "SC-APT-GET-CLEAN", ""), ("$0 autoremove [packages...]", "SC-APT-GET-AUTOREMOVE", "")], {"booleans": _INSTALL, "paths": "-C, --config", "counts": "-q, --quiet", "arrays": "-o, --option", "strings": "-t, --target-release"}),
    "apk": ("SC-APK", [("$0 add [packages...]", "SC-APK-ADD", ""), ("$0 del [packages...]", "SC-APK-DEL", ""), ("$0 update", "SC-APK-UPDATE", ""), ("$0 upgrade", "SC-APK-UPGRADE", "")], {"booleans": "--no-cache; -U, --update-cache; -u, --upgrade; --purge; -q, --quiet; -f, --force", "strings": "-t, --virtual; -X, --repository"}),
    "yum": ("SC-YUM", [("$0 install [packages...]", "SC-YUM-INSTALL", ""), ("$0 update [packages...]", "SC-YUM-UPDATE", ""), ("$0 remove [packages...]", "SC-YUM-REMOVE", ""), ("$0 clean <target>", "SC-YUM-CLEAN", "")], {"booleans": "-y, --assumeyes; -q, --quiet", "strings": "--enablerepo"}),
    "pip": ("SC-PIP", [("$0 install [packages...]", "SC-PIP-INSTALL", ""), ("$0 uninstall [packages...]", "SC-PIP-UNINSTALL", "")], {"booleans": "--no-cache-dir; -U, --upgrade; -q, --quiet; --user; --pre", "paths": "-r, --requirement; -e, --editable", "strings": "-i, --index-url"}),
    "npm": ("SC-NPM", [("$0 install [packages...]", "SC-NPM-INSTALL", ""), ("$0 run <script>", "SC-NPM-RUN", ""), ("$0 cache <action>", "SC-NPM-CACHE", "")], {"booleans": "-g, --global; --production; --force; --save"}),
    "curl": ("SC-CURL", [("$0 [url...]", "SC-CURL", "")], {"booleans": "-L, --location; -f, --fail; -s, --silent; -S, --show-error; -O, --remote-name; -k, --insecure", "paths": "-o, --output", "strings": "-X, --request; -d, --data; -u, --user; --retry", "arrays": "-H, --header"}),
    "wget": ("SC-WGET", [("$0 [url...]", "SC-WGET", "")], {"booleans": "-q, --quiet; -c, --continue; --no-check-certificate; --no-verbose", "paths": "-O, --output-document; -P, --directory-prefix", "strings": "--header; -t, --tries"}),
    "git": ("SC-GIT", [("$0 clone <url> [directory]", "SC-GIT-CLONE", ""), ("$0 checkout [refs...]", "SC-GIT-CHECKOUT", ""), ("$0 pull [refs...]", "SC-GIT-PULL", "")], {"booleans": "--recursive; -q, --quiet", "strings": "-b, --branch; --depth"}),
    "mkdir": ("SC-MKDIR", [("$0 [paths...]", "SC-MKDIR", "")], {"booleans": "-p, --parents; -v, --verbose; -Z; --help; --version", "strings": "-m, --mode; --context"}),
    "cp": ("SC-CP", [("$0 [source...] <dest>", "SC-CP", "")], {"booleans": "-r, -R, --recursive; -a, --archive; -f, --force; -p, --preserve; -v, --verbose"}),
    "mv": ("SC-MV", [("$0 [paths...]", "SC-MV", "")], {"booleans": "-f, --force; -n, --no-clobber; -v, --verbose"}),
    "tar": ("SC-TAR", [("$0 [paths...]", "SC-TAR", "")], {"booleans": "-x, --extract; -z, --gzip; -j, --bzip2; -J, --xz; -c, --create; -v, --verbose", "paths": "-f, --file; -C, --directory", "strings": "--strip-components"}),
    "unzip": ("SC-UNZIP", [("$0 <file>", "SC-UNZIP", "")], {"booleans": "-q, --quiet; -o, --overwrite", "paths": "-d, --directory"}),
    "chmod": ("SC-CHMOD", [("$0 <mode> [paths...]", "SC-CHMOD", "")], {"booleans": "-R, --recursive; -v, --verbose"}),
    "set": ("SC-SET", [("$0", "SC-SET", "")], {"booleans": "-e; -u; -x; -o", "strings": ""}),
    "rm": ("SC-RM", [("$0 [paths...]", "SC-RM", "")], {"booleans": "-r, -R, --recursive; -f, --force; -v, --verbose"}),
}
#: Positionals and options that hold paths.
PATHS = {"paths", "source", "dest", "file", "directory"}


def options(groups):
    """alias -> (kind, longest name, least alias) of an option table."""
    out = {}
    for kind, text in groups.items():
        for names in filter(None, (x.strip() for x in text.split(";"))):
            aliases = [a.strip() for a in names.split(",")]
            name = max(aliases, key=len).lstrip("-")
            out |= {a: (kind, name) for a in aliases}
    return out


def parsed(command, args, grammar=None):
    """The typed subtree of a command and its words, or None where no scenario fits.

    The first scenario that parses wins. Bundled short flags count singly; `--name=value` is a
    flag and its value; a dashed word that no option names fits nothing.
    """
    known = (grammar or GRAMMAR).get(command)
    if not known:
        return None
    prefix, scenarios, groups = known
    for template, name, must, *own in scenarios:  # a scenario may bring options of its own
        table = options(own[0] if own else groups)
        flags, words, ok, todo = {}, [], True, list(args)
        while todo and ok:
            a = todo.pop(0)
            if a == "--":
                words, todo = words + todo, []
            elif not a.startswith("-") or a == "-":
                words.append(a)
            else:
                head, eq, tail = a.partition("=")
                if head in table:
                    todo = [tail, *todo] if eq and tail and table[head][0] not in ("booleans", "counts") else todo
                    got = [head]
                elif not a.startswith("--") and all(f"-{c}" in table for c in a[1:]) and len(a) > 2:
                    got = [f"-{c}" for c in a[1:]]
                else:
                    ok = False
                    break
                for k, g in enumerate(got):
                    kind, long = table[g]
                    if kind in ("booleans", "counts"):
                        flags.setdefault(long, (kind, []))
                    elif todo and k == len(got) - 1:
                        flags.setdefault(long, (kind, []))[1].append(todo.pop(0))
                    else:
                        ok = False
        slots = template.split()[1:]
        subs = [s for s in slots if s[0] not in "<["]
        if not ok or words[:len(subs)] != subs or any(not set(args) & {x.strip() for x in m.split(",")} for m in filter(None, must.split(";"))):
            continue
        words, slots = words[len(subs):], slots[len(subs):]
        after, bound = sum(s[0] == "<" for s in slots), {}
        for i, s in enumerate(slots):
            key = s.strip("<>[].")
            later = sum(x[0] == "<" for x in slots[i + 1:])
            if s.endswith("...]"):
                n = max(0, len(words) - later)
                bound[key], words = (True, words[:n]), words[n:]
            elif words and (s[0] == "<" or len(words) > later):
                bound[key], words = (False, words[:1]), words[1:]
            elif s[0] == "<":
                ok = False
        if not ok or words:
            continue
        leaf = lambda key, v: {"type": "BASH-PATH" if key in PATHS else "BASH-LITERAL", "value": v, "children": []}
        kids = []
        for long, (kind, values) in flags.items():
            p = f"{prefix}-{long.upper()}"
            if kind in ("booleans", "counts"):
                kids.append({"type": f"{prefix}-F-{long.upper()}", "children": []})
            elif kind == "arrays":
                kids.append({"type": p.rstrip("S") + "S", "children": [{"type": p.rstrip("S"), "children": [leaf(long, v)]} for v in values]})
            else:
                kids.append({"type": p, "children": [leaf("paths" if kind == "paths" else long, values[-1])]})
        for key, (many, values) in bound.items():
            p = f"{prefix}-{key.upper()}"
            if many and values:
                kids.append({"type": p.rstrip("S") + "S", "children": [{"type": p.rstrip("S"), "children": [leaf(key, v)]} for v in values]})
            elif not many:
                kids.append({"type": p, "children": [leaf(key, values[0])]})
        return {"type": name, "children": kids}
    return None


def enriched(tree, grammar=None):
    """Every MAYBE-SEMANTIC-COMMAND as its typed subtree, UNKNOWN where the grammar has none; repeated
    while one is left, so commands within arguments are reached."""
    def edit(n, parents):
        if n["type"] != "MAYBE-SEMANTIC-COMMAND":
            return None
        parts = {c["type"]: c for c in n["children"]}
        try:
            command = T.unparsed(parts["BASH-COMMAND-COMMAND"])
            args = [T.unparsed(a) for a in parts.get("BASH-COMMAND-ARGS", {"children": []})["children"]]
            got = parsed(command, args, grammar)
        except (KeyError, ValueError):
            got = None
        return ("replace", 0, got or {"type": "UNKNOWN", "children": []})
    while any(n["type"] == "MAYBE-SEMANTIC-COMMAND" for _, n in T.walk(tree)):  # each round leaves fewer
        tree = T.edited(tree, edit) or {"type": "UNKNOWN", "children": []}
    return tree


def literal(n):
    """The text of a value node, quotes around it stripped."""
    if n.get("children"):
        return "".join(filter(None, map(literal, n["children"])))
    return str(n.get("value") or "")


def substituted(tree):
    """Variables by what ENV, ARG and assignments before them say, in document order.

    An unbound one becomes BASH-VARIABLE-VALUE `$name`; strings of DOCKER-LITERAL and DOCKER-PATH are interpolated.
    """
    env = {}

    def put(text):
        return re.sub(r"\$\{(\w+)\}|\$(\w+)", lambda m: env.get(m[1] or m[2], m[0]), text)

    def visit(n):
        kind, kids = n["type"], n.get("children") or []
        if kind == "BASH-VARIABLE":
            name = n.get("value") or ""
            return {"type": "BASH-LITERAL", "value": env[name], "children": []} if name in env else {"type": "BASH-VARIABLE-VALUE", "value": f"${name}", "children": []}
        out = {k: v for k, v in n.items() if k != "children"} | {"children": [visit(c) for c in kids]}
        if kind in ("DOCKER-LITERAL", "DOCKER-PATH") and n.get("value"):
            out["value"] = put(str(n["value"]))
        if kind in ("BASH-ASSIGN", "DOCKER-ENV", "DOCKER-ARG") and out["children"]:
            pairs = out["children"]
            for a, b in zip(pairs[0::2], [*pairs[1::2], None][:len(pairs[0::2])]):
                env[literal(a).strip()] = literal(b).strip().strip("\"'") if b is not None else ("UNDEFINE" if kind == "DOCKER-ARG" else "")
        return out

    return visit(tree)


def folded(tree):
    """Concatenations of literals alone as one literal; whole-number sums and products are worked out."""
    def edit(n, parents):
        if n["type"] == "BASH-CONCAT" and n["children"] and all(c["type"] == "BASH-LITERAL" for c in n["children"]):
            text = "".join(str(c.get("value") or "") for c in n["children"])
            if m := re.fullmatch(r"\s*(\d{1,9})\s*([+*-])\s*(\d{1,9})\s*", text):
                a, b = int(m[1]), int(m[3])
                text = str({"+": a + b, "*": a * b, "-": a - b}[m[2]])
            return ("replace", 0, {"type": "BASH-LITERAL", "value": text, "children": []})
        if n["type"] == "SC-APK-PACKAGE" and len(n["children"]) == 1 and str(n["children"][0].get("value") or "").startswith("."):
            return ("replace", 0, {"type": f"SC-APK-VIRTUAL:{n['children'][0]['value']}", "children": []})
        return None
    return T.edited(tree, edit)


def split_runs(tree):
    """A RUN of one script as a RUN for each of its commands; one level of && parts too."""
    out = []
    for i in tree.get("children") or []:
        kids = i.get("children") or []
        if i["type"] == "DOCKER-RUN" and len(kids) == 1 and kids[0]["type"] == "BASH-SCRIPT":
            for c in kids[0].get("children") or []:
                parts = [x for m in c["children"] for x in (m.get("children") or [m])] if c["type"] == "BASH-AND-IF" else [c]
                out += [{"type": "DOCKER-RUN", "children": [{"type": "BASH-SCRIPT", "children": [p]}]} for p in parts]
        else:
            out.append(i)
    return {**tree, "children": out}


def processed(docs, grammar=None):
    """docs(file_sha, ast) with the tree enriched, variables put in, constants folded and RUNs split."""
    import json

    def run(sha, t):
        return [{"file_sha": sha, "ast": json.dumps(split_runs(folded(substituted(enriched(t, grammar)))), ensure_ascii=False)}]

    return T.mapped_trees(docs, run, "file_sha string, ast string")
