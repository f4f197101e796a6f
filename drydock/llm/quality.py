"""Quality rules: a threshold table compiled into one projection of built-in expressions.

Null and empty texts have no words and fail; the rows of null or repeated doc_ids are judged
each by itself; texts of any length are read whole; no measure knows ties; an empty table
gives no rows; further columns are not read (scored) or stay with their row (kept).
"""
from pyspark.sql import functions as F

SPACE = "[\\x20\\x09-\\x0D]"
#: Frequent function words of the four languages (fixed values).
STOP = sorted(set("""the of and to in is that for with as was on a an at it he she they we you i this these those be are were been have has had not no from or but by
his her their its which who will would can all so if there what when one do than then them our your my me us into out up about also only
de la le et les des en que du une un dans pour qui est pas plus par sur au aux ce cette ces il elle ils elles nous vous je se sa son ses ne ou mais avec sont être été leur leurs comme tout
el y los del las una unos unas por con para no su sus al lo como más pero o es fue ha han este esta estos estas ser sobre entre también ya muy sin
der die und das von mit ist zu den ein eine einer eines einem einen nicht auch sich auf für dem im am aus bei nach wie oder aber wird werden sind war hat haben er sie wir ihr ich so nur noch zum zur über um durch""".split()))
#: Signs that may stand around a word.
PUNCT = ".,;:!?\"'()[]{}<>/*_#|~`-–—…«»‹›„“”‚‘’¿¡"
#: Codes of the languages that STOP holds; a text said to be in another one has no stop_ratio rule.
LANGS = "en fr de es eng fra fre deu ger spa".split()
#: A ratio says nothing about a text of fewer words or lines than these.
MIN_STOP_WORDS, MIN_DUP_LINES = 50, 10
#: Words of a text that are looked at first for stop words.
FIRST_WORDS = 60
#: name, lowest, highest; a document is kept when every ratio lies within its row.
RULES = [("symbol_ratio", None, 0.1), ("dup_line_ratio", None, 0.3), ("pipe_line_ratio", None, 0.5), ("mean_word_length", 1.0, 20.0), ("stop_ratio", 0.005, None), ("bang_ratio", None, 0.5)]


def measures():
    """Column expressions by name, over `text`; later ones use earlier ones."""
    rc = lambda p: F.regexp_count("text", F.lit(p)).cast("long")
    return [
        {"text": F.coalesce("text", F.lit(""))},
        {"words": F.array_remove(F.split("text", SPACE + "+"), ""), "lines": F.filter(F.split("text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))},
        {"n_words": F.size("words").cast("long"), "wh": F.transform("words", lambda w: F.xxhash64(w)), "word_chars": F.length("text").cast("long") - rc(SPACE),
         "n_symbols": rc("[#*$%&|<>]"), "n_foreign": rc(r"[\x{370}-\x{10FFFF}&&\p{L}&&\P{IsLatin}]"), "n_unspaced": rc(r"[\x{E00}-\x{FFFFF}&&[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]]"), "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long")},
        {"grams": F.expr("CASE WHEN n_words < 6 THEN array() ELSE transform(sequence(0, int(n_words) - 5), i -> xxhash64(wh[i], wh[i+1], wh[i+2], wh[i+3], wh[i+4])) END")},
        {"runs": F.expr("CASE WHEN size(array_distinct(grams)) = size(grams) THEN array() ELSE sort_array(transform(grams, (h, i) -> named_struct('h', h, 'i', i))) END")},
        {"starts": F.expr("sort_array(transform(filter(transform(runs, (r, j) -> named_struct('i', r.i, 'dup', (j > 0 AND runs[greatest(j - 1, 0)].h = r.h) OR (j + 1 < size(runs) AND runs[least(j + 1, size(runs) - 1)].h = r.h))), x -> x.dup), x -> x.i))")},
        {"n_repeat_words": F.expr("CASE WHEN size(starts) = 0 THEN 0L ELSE aggregate(sequence(1, size(starts)), 5L, (a, j) -> a + CASE WHEN j = size(starts) THEN 0 ELSE least(5, starts[least(j, size(starts) - 1)] - starts[j - 1]) END) END")},
    ]


def _stops(words):
    return F.size(F.filter(words, lambda w: F.lower(F.btrim(w, F.lit(PUNCT))).isin(STOP)))


def ratios():
    n = F.greatest("n_words", F.lit(1))
    return {"symbol_ratio": F.col("n_symbols") / n, "dup_line_ratio": F.col("n_dup_lines") / F.greatest(F.size("lines"), F.lit(1)),
            "pipe_line_ratio": F.size(F.filter("words", lambda w: w == "|")) / n, "mean_word_length": F.col("word_chars") / n,
            "stop_ratio": _stops(F.col("words")) / n, "bang_ratio": F.size(F.filter("words", lambda w: w.endswith("!!"))) / n}


def meaningful():
    """Where a rule may reject; rules that are not named hold for every text."""
    ours = F.col("lang").isNull() | F.regexp_extract(F.lower("lang"), "^[a-z]*", 0).isin("", *LANGS)
    return {"dup_line_ratio": F.size("lines") >= MIN_DUP_LINES, "mean_word_length": 2 * F.col("n_unspaced") < F.greatest("word_chars", F.lit(1)),
            "stop_ratio": (F.col("n_words") >= MIN_STOP_WORDS) & ours & (2 * F.col("n_foreign") <= F.col("word_chars"))}


def judged(docs):
    """docs(doc_id, text, lang, ...) with the measures, base_failed and kept; lang must be there."""
    d = docs
    for step in measures():
        d = d.withColumns(step)
    r, where, ok = ratios(), meaningful(), F.lit(True)
    for name, low, high in RULES:
        above = F.lit(True) if low is None else r[name] >= low
        if name == "stop_ratio":  # mostly the first words hold as many as the whole text needs; the others are looked at where they do not
            above = (_stops(F.slice("words", 1, FIRST_WORDS)) / F.greatest("n_words", F.lit(1)) >= low) | above
        ok = ok & (~where.get(name, F.lit(True)) | above & (F.lit(True) if high is None else r[name] <= high))
    bad = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return d.withColumns({"base_failed": bad, "kept": ~bad & ok})


def _lang(docs):
    return docs["lang"].cast("string") if "lang" in docs.columns else F.lit(None).cast("string")


def scored(docs):
    """docs (doc_id, text, lang if there is one) -> doc_id, the counts, base_failed, kept; one projection, no shuffle."""
    d = judged(docs.select("doc_id", "text", _lang(docs).alias("lang")))
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def kept(docs):
    """The rows of docs that the rules keep, with all their columns; no shuffle.

    The row number makes the projection one that filters are not pushed through: else the
    verdict would be worked out again for each measure below it.
    """
    d = judged(docs.select(F.struct("*").alias("whole_row"), "text", _lang(docs).alias("lang")))
    d = d.select("whole_row", "kept", F.monotonically_increasing_id().alias("row_number"))
    return d.where("kept AND row_number >= 0").select("whole_row.*")
