"""Text functions over columns: cleaning, tokens, hashes, titles, prompt rendering."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space as Unicode has it, as a character class of Java's regular expressions.
SPACE = "\\x09-\\x0D\\x1C-\\x20\\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000"
WORD = "[\\p{L}\\p{N}_]"

# The two training templates.
PROMPT_WITH_INPUT = (
    "Below is an instruction that describes a task, paired with an input that provides further context. "
    "Write a response that appropriately completes the request.\n\n### Instruction:\n{}\n\n### Input:\n{}\n\n### Response:\n{}"
)
PROMPT_WITHOUT_INPUT = (
    "Below is an instruction that describes a task. Write a response that appropriately completes the request.\n\n"
    "### Instruction:\n{}\n\n### Response:\n{}"
)
# Fixed value: what the sources block says when there is no source.
NO_SOURCE = "(Hech qanday tegishli manba topilmadi.)"


#: The same characters one after the other.
_SPACES = "".join(chr(c) for a, b in ((0x09, 0x0D), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)) for c in range(a, b + 1))
# Fixed value: characters of texts that may not be in composed form: marks, and letters that composition changes.
_MAY_COMPOSE = (
    "[\\p{M}\\u0340-\\u0344\\u0374\\u037E\\u0387\\u0958-\\u1FFF\\u2000\\u2001\\u2126\\u212A\\u212B\\u2329\\u232A\\u2ADC"
    "\\uF900-\\uFAFF\\uFB1D-\\uFB4E\\x{11000}-\\x{11FFF}\\x{1D15E}-\\x{1D1C0}\\x{2F800}-\\x{2FA1D}]"
)


def _without(c: Column, characters: str, instead: str = "") -> Column:
    """Each of the characters replaced; a search for bytes, and several times faster than by a table."""
    for x in characters:
        c = F.replace(c, F.lit(x), F.lit(instead))
    return c


def strip(c: Column) -> Column:
    """Without leading and trailing Unicode white space."""
    return F.btrim(c, F.lit(_SPACES))


def unix_newlines(c: Column) -> Column:
    return _without(F.replace(c, F.lit("\r\n"), F.lit("\n")), "\r", "\n")


def drop_invisible(c: Column) -> Column:
    """Without byte order marks and zero-width characters."""
    return _without(c, "\ufeff\u200b\u200c\u200d")


def drop_controls(c: Column) -> Column:
    """Without control characters other than line feed and tab."""
    return F.regexp_replace(c, "[\\p{Cc}&&[^\\n\\t]]", "")


@F.pandas_udf(T.StringType())
def _compose(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def _same(c: Column) -> Column:
    return c


def nfc(c: Column, first: Callable[[Column], Column] = _same) -> Column:
    """Composed form of first(c), which may take characters away but not bring any.

    Texts without a character that composition looks at skip Python. The test is of `c` itself, so
    that it and `first` are evaluated once.
    """
    # characters of ASCII alone never compose
    may = (F.octet_length(c) != F.length(c)) & c.rlike(_MAY_COMPOSE)
    return F.coalesce(_compose(F.when(may, first(c))), first(c))


def one_apostrophe(c: Column) -> Column:
    """ASCII and right single quotes as U+02BC; U+02BB is another letter and stays."""
    return _without(c, "'\u2019", "\u02bc")


def squeeze(c: Column) -> Column:
    """Blanks before line ends go, runs of blanks become a space, blank lines become one."""
    c = F.regexp_replace(c, "[ \\t]+\\n", "\n")
    c = F.regexp_replace(c, "[ \\t]{2,}", " ")
    return strip(F.regexp_replace(c, "\\n[ \\t]*\\n[ \\t]*(\\n[ \\t]*)+", "\n\n"))


def clean_text(c: Column, apostrophes: bool = True) -> Column:
    """All cleaning steps in their order."""
    c = nfc(c, lambda x: drop_controls(drop_invisible(unix_newlines(x))))
    return squeeze(one_apostrophe(c) if apostrophes else c)


def clean_query(c: Column, longest: int = 1000) -> Column:
    """A cleaned query of at most `longest` characters; null if nothing is left."""
    short = F.regexp_replace(F.substring(clean_text(c), 1, longest), f"[{SPACE}]+$", "")
    return F.nullif(short, F.lit(""))


def sanitize(c: Column) -> Column:
    """Composed, without control characters but tab, line feed and carriage return, stripped."""
    return strip(F.regexp_replace(nfc(c), "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]", ""))


def tokens(c: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(c), F.lit(f"{WORD}+"), F.lit(0))


def approx_tokens(c: Column) -> Column:
    """Words and single other visible characters, counted."""
    return F.regexp_count(c, F.lit(f"{WORD}+|[^\\p{{L}}\\p{{N}}_{SPACE}]"))


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(f"[^{SPACE}]+"))


def pair_hash(instruction: Column, given: Column) -> Column:
    """Hash of an instruction and its input that case and spacing do not change."""
    joined = F.concat(F.lower(strip(instruction)), F.lit("||"), F.lower(strip(F.coalesce(given, F.lit("")))))
    return F.sha2(F.regexp_replace(joined, f"[{SPACE}]+", " "), 256)


def title(text: Column, fallback: Column, longest: int = 150) -> Column:
    """The first line that is not blank, if short enough, else `fallback`."""
    first = F.get(F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x != ""), F.lit(0))
    return F.when(F.length(first) <= longest, first).otherwise(fallback)


def truncate(c: Column, notice: str, longest: int = 40_000) -> Column:
    return F.when(F.length(c) > longest, F.concat(F.substring(c, 1, longest), F.lit(notice))).otherwise(c)


def training_prompt(instruction: Column, given: Column, output: Column, end: str) -> Column:
    """The rendered example; a blank input takes the template without one."""

    def fill(template: str, *values: Column) -> Column:
        parts = template.split("{}")
        return F.concat(F.lit(parts[0]), *[x for v, p in zip(values, parts[1:], strict=True) for x in (strip(v), F.lit(p))], F.lit(end))

    given = F.coalesce(given, F.lit(""))
    return F.when(strip(given) != "", fill(PROMPT_WITH_INPUT, instruction, given, output)).otherwise(fill(PROMPT_WITHOUT_INPUT, instruction, output))


def source_block(rank: Column, text: Column, law: Column, article: Column, section: Column, page: Column) -> Column:
    """One numbered source; lines of missing fields are left out."""

    def line(label: str, value: Column, after: str = "") -> Column:
        value = F.nullif(value.cast("string"), F.lit(""))
        return F.when(value.isNotNull(), F.concat(F.lit(label), value, F.lit(after)))

    head = F.concat(F.lit("--- Manba "), rank.cast("string"), F.lit(" ---"))
    return F.concat_ws("\n", head, line("Qonun: ", law), line("Modda: ", article, "-modda"), line("Boʻlim: ", section), line("Sahifa: ", page), F.concat(F.lit("Matn: "), text))


def sources_text(rank: Column, block: Column) -> Column:
    """Aggregate: blocks by rank, a blank line between; a fixed sentence if there is none."""
    listed = F.array_sort(F.collect_list(F.struct(rank.alias("rank"), block.alias("block"))))
    return F.when(F.size(listed) == 0, NO_SOURCE).otherwise(F.array_join(F.transform(listed, lambda x: x["block"]), "\n\n"))


def embedding_prefix(model: str, kind: str) -> str:
    """What a model wants before a `passage` or `query`."""
    name = model.lower()
    if "e5" in name:
        return f"{kind}: "
    if "bge" in name and "m3" not in name and kind == "query":
        return "Represent this sentence for searching relevant passages: "
    return ""


def collection(path: Column, titles: dict[str, str] | None = None) -> Column:
    """Struct (category, collection_id, title) from a path below the corpus root."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    n = F.size(parts)
    name = F.element_at(parts, -1)
    stem = F.when(name.rlike("^.+\\.[^.]*$"), F.regexp_replace(name, "\\.[^.]*$", "")).otherwise(name)
    category = F.when(n >= 3, F.get(parts, F.lit(0))).otherwise("other")
    ident = F.when(n >= 3, F.get(parts, F.lit(1))).when(n == 2, F.get(parts, F.lit(0))).otherwise(stem)
    words = F.filter(F.split(F.replace(ident, F.lit("_"), F.lit(" ")), f"[{SPACE}]+"), lambda w: w != "")
    pretty = F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30)))), " ")
    known = F.try_element_at(F.create_map(*[F.lit(x) for kv in titles.items() for x in kv]), ident) if titles else F.lit(None)
    return F.struct(category.alias("category"), ident.alias("collection_id"), F.coalesce(known, pretty).alias("title"))


def chunk_id(document_id: Column, index: Column) -> Column:
    return F.format_string("%s::%05d", document_id.cast("string"), index.cast("int"))


def reading_minutes(words: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(words / 200 + F.lit(0.5)).cast("int"))


def confidence(score: Column) -> Column:
    score = F.coalesce(score, F.lit(0.0))
    return F.when(score >= 0.75, "high").when(score >= 0.5, "medium").otherwise("low")
