"""Text cleaning and features as Column expressions. Word characters and white space are Unicode's."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed values, in this order: UTF-8 text once read as Windows-1252, and what was meant.
MOJIBAKE = {
    "â€™": "'", "â€œ": '"', "â€\x9d": '"', 'â€"': "—",
    "Ã¡": "á", "Ã©": "é", "Ã­": "í", "Ã³": "ó", "Ãº": "ú",
    "Ã\xa0": " ", "\ufeff": "",
}
# Fixed values, in this order.
CONTRACTIONS = [("won't", "will not"), ("can't", "cannot"), ("n't", " not"), ("'re", " are"), ("'ve", " have"), ("'ll", " will"), ("'d", " would")]
# English function words.
ENGLISH = ["the", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by"]
WORD = r"[\p{L}\p{N}_]+"


@F.pandas_udf(StringType())
def nfkc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    import unicodedata

    for s in batches:
        yield s.map(lambda x: x if x is None else unicodedata.normalize("NFKC", x))


def only_where(t: Column, test, change) -> Column:
    """change(t) where test(t) holds, else t; `t` is evaluated once, whatever it is made of."""
    return F.get(F.transform(F.array(t), lambda x: F.when(test(x), change(x)).otherwise(x)), F.lit(0))


def fix_mojibake(t: Column) -> Column:
    def change(x: Column) -> Column:
        for bad, good in MOJIBAKE.items():
            x = F.replace(x, F.lit(bad), F.lit(good))
        return x

    return only_where(t, lambda x: x.rlike("[" + "".join(sorted({k[0] for k in MOJIBAKE})) + "]"), change)


def normalize_space(t: Column, keep_structure: bool = True) -> Column:
    # Fixed patterns.
    if not keep_structure:
        return F.regexp_replace(t, r"(?U)\s+", " ")
    t = F.regexp_replace(t, r"(?U)\n\s*\n\s*\n+", "\n\n")
    t = F.regexp_replace(t, r"[ \t]+", " ")
    return F.regexp_replace(t, r" *\n *", "\n")


def drop_special(t: Column, keep_punctuation: bool = True) -> Column:
    return F.regexp_replace(t, r"[^A-Za-z0-9\s.,!?;:()\[\]{}\"'/-]" if keep_punctuation else r"[^\p{L}\p{N}\s]", "")


def fix_common(t: Column) -> Column:
    # Fixed patterns.
    t = F.regexp_replace(t, r"\.{3,}", "...")
    t = F.regexp_replace(t, r"(?U)\s+([,.!?;:])", "$1")
    t = F.regexp_replace(t, r"([.!?])([A-Z])", "$1 $2")

    def expand(x: Column) -> Column:
        for short, long in CONTRACTIONS:
            x = F.replace(x, F.lit(short), F.lit(long))
        return x

    return only_where(t, lambda x: F.contains(x, F.lit("'")), expand)


def clean(t: Column, keep_structure: bool = True, special: bool = False, unicode_form: bool = True, compat: bool = False) -> Column:
    """Mojibake, NFKC, white space, special characters on request, common faults, ends. Null gives "".

    NFKC is the one step that needs Python; `unicode_form=False` leaves it out. It comes after the
    mojibake table, some of whose keys it would change; with `compat` it comes first, as it once did.
    """
    t = F.coalesce(t, F.lit(""))
    t = nfkc(t) if unicode_form and compat else t
    t = fix_mojibake(t)
    t = nfkc(t) if unicode_form and not compat else t
    t = normalize_space(t, keep_structure)
    t = drop_special(t) if special else t
    return F.regexp_replace(fix_common(t), r"(?U)^\s+|\s+$", "")


def words(t: Column) -> Column:
    """Runs between white space."""
    return F.filter(F.split(t, r"(?U)\s+"), lambda x: x != "")


def word_count(t: Column) -> Column:
    return F.size(words(t))


def tokens(t: Column) -> Column:
    """Words and single punctuation marks, the default tokenizer where no vocabulary is given."""
    return F.regexp_extract_all(t, F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"), F.lit(0))


def paragraphs(t: Column) -> Column:
    return F.filter(F.split(t, "\n\n"), lambda x: F.regexp_replace(x, r"\s", "") != "")


def has_headers(t: Column) -> Column:
    return t.rlike(r"(?m)^#{1,6}\s")


def has_lists(t: Column) -> Column:
    return t.rlike(r"(?m)^\s*[-*+]\s")


def has_code(t: Column) -> Column:
    return t.rlike("```|`[^`]+`")


def features(t: Column) -> list[Column]:
    return [
        F.length(t).alias("chars"), word_count(t).alias("words"), F.size(F.split(t, "\n")).alias("lines"), F.size(paragraphs(t)).alias("paragraphs"),
        has_headers(t).alias("has_headers"), has_lists(t).alias("has_lists"), has_code(t).alias("has_code"),
    ]


def guess_language(t: Column) -> Column:
    """`en` if three of the English function words are among the words of the first 1000 characters."""
    seen = F.array_distinct(F.regexp_extract_all(F.lower(F.substring(t, 1, 1000)), F.lit(WORD), F.lit(0)))
    return F.when(F.size(F.array_intersect(seen, F.array(*map(F.lit, ENGLISH)))) >= 3, "en").otherwise("unknown")


# Fixed patterns, first match wins; multi-line, in any case.
CONTENT = {
    "code": [r"```[\w]*\n[\s\S]*?```", r"`[^`]+`", r"def\s+\w+\([^)]*\):", r"class\s+\w+[^:]*:", r"import\s+\w+", r"from\s+\w+\s+import", r"function\s+\w+\([^)]*\)", r"var\s+\w+\s*="],
    "table": [r"\|[^\n]*\|", r"\+-+\+", r"\t[^\n]*\t[^\n]*\t"],
    "list": [r"^\s*[-*+]\s+", r"^\s*\d+\.\s+", r"^\s*[a-zA-Z]\)\s+"],
    "header": [r"^#{1,6}\s+", r"^.+\n[=-]+$"],
    "quote": [r"^>\s+", r"^\s*[\"'][^\"']*[\"']$"],
}


def content_type(t: Column) -> Column:
    out = F.lit("text")
    for name, patterns in reversed(CONTENT.items()):
        out = F.when(t.rlike("(?im)" + "|".join(f"(?:{p})" for p in patterns)), name).otherwise(out)
    return F.when(t.rlike(r"\S"), out).otherwise("text")


def complexity(t: Column) -> Column:
    """0 to 1 from sentence length, word variety and punctuation."""
    w = words(t)
    n, sentences = F.size(w), F.size(F.split(t, r"\."))
    long = F.least(n / sentences / 20, F.lit(1.0))
    unique = F.size(F.array_distinct(F.transform(w, F.lower))) / n
    marks = F.length(F.regexp_replace(t, r"[^.,!?;:]", "")) / F.length(t)
    return F.when(n == 0, 0.0).otherwise(F.least(F.lit(1.0), 0.4 * long + 0.4 * unique + 0.2 * 10 * marks))


def preview(t: Column, n: int = 200) -> Column:
    return F.when(F.length(t) > n, F.concat(F.substring(t, 1, n), F.lit("..."))).otherwise(t)


def grade(score: Column) -> Column:
    # The lowest score of each grade.
    out = F.lit("F")
    for least, name in [(0.3, "D"), (0.4, "C"), (0.5, "C+"), (0.6, "B"), (0.7, "B+"), (0.8, "A"), (0.9, "A+")]:
        out = F.when(score >= least, name).otherwise(out)
    return out


# The least score of each verdict, best first, and the verdict under all of them.
VERDICTS = {
    "size": [(0.8, "Excellent - Very consistent chunk sizes"), (0.6, "Good - Reasonably consistent chunk sizes"), (0.4, "Fair - Some variation in chunk sizes"), (None, "Poor - Highly variable chunk sizes")],
    "coverage": [(0.95, "Excellent - Complete coverage of original content"), (0.85, "Good - Most content preserved"), (0.7, "Fair - Some content may be missing"), (None, "Poor - Significant content loss")],
    "overlap": [(0.8, "Excellent - Optimal overlap strategy"), (0.6, "Good - Reasonable overlap"), (None, "Poor - Suboptimal overlap strategy")],
    "boundary": [(0.8, "Excellent - Clean sentence boundaries"), (0.6, "Good - Mostly clean boundaries"), (0.4, "Fair - Some awkward boundaries"), (None, "Poor - Many awkward boundaries")],
    "coherence": [(0.8, "Excellent - Highly coherent chunks"), (0.6, "Good - Generally coherent"), (0.4, "Fair - Some coherence issues"), (None, "Poor - Low coherence")],
    "overall": [(0.8, "Excellent chunking quality - Ready for production use"), (0.6, "Good chunking quality - Minor improvements possible"), (0.4, "Fair chunking quality - Consider adjusting parameters"), (None, "Poor chunking quality - Significant improvements needed")],
}


def verdict(score: Column, metric: str) -> Column:
    *steps, (_, out) = VERDICTS[metric]
    out = F.lit(out)
    for least, said in reversed(steps):
        out = F.when(score >= least, said).otherwise(out)
    return out


def structure(t: Column) -> list[Column]:
    """What a text is made of, line by line. The list pattern is a fixed one, wider than has_lists()."""
    lines = F.split(t, "\n")
    return [
        F.size(lines).alias("total_lines"), F.size(F.filter(lines, lambda x: ~x.rlike(r"(?U)\S"))).alias("empty_lines"),
        (F.aggregate(lines, F.lit(0), lambda n, x: n + F.length(x)) / F.size(lines)).alias("avg_line_length"), F.contains(t, F.lit("```")).alias("has_code_blocks"),
        t.rlike(r"(?m)^#{1,6}\s+").alias("has_headers"), t.rlike(r"(?m)^\s*[-*+\d]+[.)\s]").alias("has_lists"),
        F.size(paragraphs(t)).alias("paragraphs"), content_type(t).alias("content_type"),
    ]


def truncated(t: Column, most: int, how: str = "end") -> Column:
    """A text within `most` characters: its beginning (`end` is cut), both ends (`middle` is cut), or its
    beginning up to the last full sentence that fits (`smart`; as `end` where none does)."""
    if how == "middle":
        half = (most - 3) // 2
        cut = F.concat(F.substring(t, 1, most - 3 - half), F.lit("..."), F.substring(t, -half, half))
    elif how in ("end", "smart"):
        cut = F.concat(F.substring(t, 1, most - 3), F.lit("..."))
        if how == "smart":
            whole = F.regexp_extract(F.substring(t, 1, most), r"(?s)^(.*[.!?])(?:\s|$)", 1)
            cut = F.when(whole != "", whole).otherwise(cut)
    else:
        raise ValueError(f"unknown truncation: {how}")
    return F.when(F.length(t) <= most, t).otherwise(cut)


def route_answer(t: Column) -> Column:
    """Topic of a prompt by key words, first match wins."""
    low = F.lower(t)
    has = lambda *ws: F.greatest(*[F.contains(low, F.lit(w)).cast("int") for w in ws]) == 1
    return F.when(has("machine learning", "ml"), "machine_learning").when(has("deep learning", "neural"), "deep_learning").when(has("artificial intelligence", "ai"), "artificial_intelligence").otherwise("generic")


def valid_id(c: Column, extra: str = "_-", most: int = 100) -> Column:
    """Letters and digits with the separators `extra`, at least one letter or digit, 1 to `most` long."""
    sep = "".join("\\" + x for x in extra)
    return c.rlike(rf"^[\p{{L}}\p{{N}}{sep}]+$") & c.rlike(r"[\p{L}\p{N}]") & F.length(c).between(1, most)


def valid_table_name(c: Column) -> Column:
    return c.rlike(r"^[\p{L}\p{N}_]+$") & (F.length(c) <= 63)


def valid_request(query: Column, k: Column, longest: int = 1000, most: int = 50) -> Column:
    """A query text of 1 to `longest` characters that isn't blank, and 1 to `most` results."""
    return F.length(query).between(1, longest) & query.rlike(r"(?U)\S") & k.between(1, most)


def map_matches(metadata: Column, wanted: dict[str, str] | None) -> Column:
    """Each wanted key is there with the wanted value; nothing wanted is always met."""
    out = F.lit(True)
    for k, v in (wanted or {}).items():
        out &= F.coalesce(metadata[k] == F.lit(v), F.lit(False))
    return out


def json_equals(doc: Column, wanted: dict) -> Column:
    """Each key's text equals str(value); a Python bool's text is capitalised and so never equals JSON's."""
    out = F.lit(True)
    for k, v in wanted.items():
        out &= F.get_json_object(doc, f"$.{k}") == F.lit(str(v))
    return out


def json_contains(doc: Column, wanted: dict | None) -> Column:
    """Containment with types: nested keys must be there with equal values; None asks nothing."""
    out, parsed = F.lit(True), F.try_parse_json(doc)

    def leaf(path: str, v) -> Column:
        if isinstance(v, dict):
            each = F.lit(True)
            for k, x in v.items():
                each &= leaf(f"{path}.{k}", x)
            return each
        kind = {bool: "boolean", int: "bigint", float: "double"}.get(type(v), "string")
        typed = F.schema_of_variant(F.try_variant_get(parsed, path, "variant"))
        want = {"boolean": ["BOOLEAN"], "string": ["STRING"]}.get(kind)
        same = F.try_variant_get(parsed, path, kind) == F.lit(v)
        return F.coalesce(same & (typed.isin(want) if want else ~typed.isin("STRING", "BOOLEAN")), F.lit(False))

    for k, v in (wanted or {}).items():
        out &= leaf(f"$.{k}", v)
    return out
