"""Structure of legal texts: lines with offsets, headings, breadcrumbs, articles, pages."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.text import squeeze, strip
from siltstone.session import parts_for

# Words for ordinal numbers in headings, and the patterns of headings.
ORDINALS = "Birinchi|Ikkinchi|Uchinchi|Toʻrtinchi|Beshinchi|Oltinchi|Yettinchi|Sakkizinchi|Toʻqqizinchi|Oʻninchi"


#: Characters of text of a part.
PART = 16_000_000


@dataclass(frozen=True)
class Patterns:
    """What headings look like: number in group 1, title on the same line in group 2."""

    article: str = "^([0-9][0-9\\-]*)-modda\\.\\s*(.*)$"
    chapter: str = "^([0-9]+|[IVXLCDM]+)[-\\s]*[Bb][Oo][Bb]\\.?[ \\t]*(.*)$"
    section: str = f"(?iu)^([IVXLCDM]+|{ORDINALS})\\s+BOʻLIM\\.?[ \\t]*(.*)$"
    subsection: str = "(?iu)^([0-9]+)-Kichik boʻlim\\.?[ \\t]*(.*)$"
    part: str = f"^({ORDINALS}|UMUMIY|MAXSUS)\\s+[Qq][Ii][Ss][Mm]\\.?$"
    noise: tuple[str, ...] = ("(?m)^Oldingi tahrirga qarang\\.[ \\t]*\\n?", "(?m)^\\(.*\\)[ \\t]*\\n?", "(?m)^[ \\t]*LexUZ sharhi[ \\t]*\\n.*\\n?")
    longest_title: int = 120


LEGAL = Patterns()


def strip_noise(text: Column, patterns: Patterns = LEGAL) -> Column:
    """Without boilerplate lines, in the order of the patterns, then squeezed."""
    for p in patterns.noise:
        text = F.regexp_replace(text, p, "")
    return squeeze(text)


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, pos, raw, line, offset): each line, stripped too, and where it starts in the text.

    Texts are dealt by id before they are cut, in parts of about PART characters, so that what
    later steps sort in a task does not grow with the table.
    """
    parts = parts_for(docs.sparkSession, docs.agg(F.sum(F.length(text_col))).first()[0] or 0, PART)
    each = docs.select(id_col, text_col).repartition(parts, id_col).select(id_col, F.posexplode(F.split(text_col, "\n")).alias("pos", "raw"))
    before = Window.partitionBy(id_col).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return each.select(id_col, "pos", "raw", strip(F.col("raw")).alias("line"), F.coalesce(F.sum(F.length("raw") + 1).over(before), F.lit(0)).alias("offset"))


def classify(rows: DataFrame, id_col: str = "doc_id", patterns: Patterns = LEGAL) -> DataFrame:
    """lines() with kind, number and title; a line taken as the title above it has kind `title`.

    A chapter, section or subsection without a title takes the next line, if that is short and
    no article, chapter or section. Lines that could both take and be taken alternate.
    """
    line = F.col("line")
    kind = (
        F.when(line == "", "blank")
        .when(line.rlike(patterns.article), "article")
        .when(line.rlike(patterns.chapter), "chapter")
        .when(line.rlike(patterns.section), "section")
        .when(line.rlike(patterns.subsection), "subsection")
        .when(line.rlike(patterns.part), "part")
        .otherwise("content")
    )

    def group(i: int) -> Column:
        out = None
        for name in ("article", "chapter", "section", "subsection"):
            found = F.regexp_extract(line, getattr(patterns, name), i)
            out = F.when(F.col("kind") == name, found) if out is None else out.when(F.col("kind") == name, found)
        return out

    by_pos = Window.partitionBy(id_col).orderBy("pos")
    named = rows.withColumn("kind", kind).withColumns({"number": group(1), "title": strip(group(2))})
    bare = F.col("kind").isin("chapter", "section", "subsection") & (F.col("title") == "")
    fits = (line != "") & (F.length(line) <= patterns.longest_title) & ~F.col("kind").isin("article", "chapter", "section")
    named = named.withColumns({"bare": bare, "fits": fits})
    named = named.withColumn("could", F.coalesce(F.lag("bare").over(by_pos), F.lit(False)) & F.col("fits"))
    # islands of lines that could be taken: every other one is, the first included
    named = named.withColumn("island", F.col("pos") - F.row_number().over(Window.partitionBy(id_col, "could").orderBy("pos")))
    named = named.withColumn("nth", F.row_number().over(Window.partitionBy(id_col, "could", "island").orderBy("pos")))
    named = named.withColumn("taken", F.col("could") & (F.col("nth") % 2 == 1))
    below = F.when(F.lead("taken").over(by_pos), F.lead("line").over(by_pos))
    named = named.withColumn("title", F.when(F.col("bare"), F.coalesce(below, F.lit(""))).otherwise(F.col("title")))
    return named.withColumn("kind", F.when(F.col("taken"), "title").otherwise(F.col("kind"))).drop("bare", "fits", "could", "island", "nth", "taken")


def breadcrumbs(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """classify() with the breadcrumb in force at each line.

    Subsections overwrite sections; a part sets the section and clears the chapter.
    """
    titled = lambda head: F.when(F.col("title") != "", F.concat(head, F.lit(". "), F.col("title"))).otherwise(head)
    section = (
        F.when(F.col("kind") == "section", titled(F.concat("number", F.lit(" boʻlim"))))
        .when(F.col("kind") == "subsection", titled(F.concat("number", F.lit("-kichik boʻlim"))))
        .when(F.col("kind") == "part", F.col("line"))
    )
    upto = Window.partitionBy(id_col).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    since = Window.partitionBy(id_col, "parts").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumns({"section": F.last(section, ignorenulls=True).over(upto), "parts": F.sum((F.col("kind") == "part").cast("int")).over(upto)})
    chapter = F.when(F.col("kind") == "chapter", titled(F.concat("number", F.lit("-bob"))))
    out = out.withColumn("chapter", F.last(chapter, ignorenulls=True).over(since))
    return out.withColumn("breadcrumb", F.nullif(F.concat_ws(" > ", "section", "chapter"), F.lit(""))).drop("parts")


def articles(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", patterns: Patterns = LEGAL) -> DataFrame:
    """(id, nth, article_number, section, text, start_offset): articles with their bodies.

    What stands before the first article is no article; headings are no body.
    """
    marked = breadcrumbs(classify(lines(docs, id_col, text_col), id_col, patterns), id_col)
    upto = Window.partitionBy(id_col).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    numbered = marked.withColumn("nth", F.sum((F.col("kind") == "article").cast("int")).over(upto))
    body = numbered.where((F.col("nth") > 0) & F.col("kind").isin("article", "content"))
    head = F.col("kind") == "article"
    return body.groupBy(id_col, "nth").agg(
        F.max(F.when(head, F.col("number"))).alias("article_number"),
        F.max(F.when(head, F.col("breadcrumb"))).alias("section"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("text"),
        F.max(F.when(head, F.col("offset"))).alias("start_offset"),
    )


def distinct_articles(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The first of the articles of a document with equal number and text."""
    w = Window.partitionBy(id_col, "article_number", F.sha2("text", 256)).orderBy("nth")
    return found.withColumn("again", F.row_number().over(w)).where("again = 1").drop("again")


def page_begins(pages: Column) -> Column:
    """Where each of several pages starts, parted by two characters; null for one page or none."""
    lengths = F.transform(pages, lambda p: F.length(p).cast("bigint") + 2)
    begins = F.transform(F.sequence(F.lit(0), F.size(pages) - 1), lambda i: F.aggregate(F.slice(lengths, 1, i), F.lit(0).cast("bigint"), lambda a, n: a + n))
    return F.when(F.size(pages) > 1, begins)


def page_number(begins: Column | str, offset: Column | str) -> Column:
    """The last page that starts at or before the offset, from 1; null without page_begins()."""
    begins, offset = (F.col(c) if isinstance(c, str) else c for c in (begins, offset))
    return F.when(begins.isNotNull(), F.size(F.filter(begins, lambda b: b <= offset)))


def page_of(offsets: DataFrame, pages: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """`offsets` (id, offset) with page_number: the last page that starts at or before the offset.

    `pages` is (id, pages array<string>); pages are parted by two characters. Null where a
    document has one page or none.
    """
    lengths = F.transform("pages", lambda p: F.length(p).cast("bigint"))
    begins = F.transform(F.sequence(F.lit(0), F.size("pages") - 1), lambda i: F.aggregate(F.slice("lengths", 1, i), F.lit(0).cast("bigint"), lambda a, n: a + n + 2))
    known = pages.where(F.size("pages") > 1).withColumn("lengths", lengths).select(F.col(id_col).alias("of"), begins.alias("begins"))
    joined = offsets.join(known, F.col(id_col) == F.col("of"), "left")
    return joined.withColumn("page_number", F.when(F.col("begins").isNotNull(), F.size(F.filter("begins", lambda b: b <= F.col("offset"))))).drop("of", "begins")
