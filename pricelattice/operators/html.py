"""Cards of HTML pages: blocks of one tag, nested ones by depth; their lines, labelled values and page loops. Regular expressions and
windows in the JVM, no parser."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nested_cards(df: DataFrame, page: str, html: str, tag: str, marked: str = "") -> DataFrame:
    """page, card_no (by start, from 0), depth (1 outermost), inner (HTML between the card's own tags) of each <tag> block.

    Opening and closing tags raise and lower a running depth, in which a closing tag without an opening one counts for nothing; the k-th
    opening at a depth belongs to the k-th closing from it. A card that is not closed ends with the page. `marked`: a regular expression
    that the opening tag's attributes must hold. Comments, scripts and styles are cut out first. `page` must name a row.
    """
    body = F.regexp_replace(F.col(html), r"(?is)<!--.*?-->|<(script|style)\b[^>]*>.*?</\1\s*>", "")
    cut = F.split(body, rf"(?i)(?=<{tag}[\s>/])|(?<=</{tag}>)")
    rows = df.select(page, F.posexplode(cut).alias("i", "seg")).filter("seg <> ''")
    w = Window.partitionBy(page).orderBy("i")
    opens = F.col("seg").rlike(rf"(?i)^<{tag}[\s>/]").cast("int")
    closes = F.col("seg").rlike(rf"(?i)</{tag}>$").cast("int")
    rows = rows.withColumn("o", opens).withColumn("c", closes)
    # Depth after a segment, lifted by what stray closings took below 0.
    raw = F.sum(F.col("o") - F.col("c")).over(w)
    rows = rows.withColumn("raw", raw)
    floor = F.least(F.lit(0), F.min("raw").over(w))
    rows = rows.withColumn("after", F.col("raw") - floor)
    rows = rows.withColumn("before", F.coalesce(F.lag("after").over(w), F.lit(0)))
    inside = F.col("before") + F.col("o")  # depth between a segment's opening and its closing
    rows = rows.withColumn("inside", inside)
    start = rows.filter("o = 1").select(page, F.col("inside").alias("depth"), "i", F.col("seg").alias("head"))
    start = start.withColumn("k", F.row_number().over(Window.partitionBy(page, "depth").orderBy("i")))
    stop = rows.filter("c = 1 and inside > 0").select(F.col(page).alias("_p"), F.col("inside").alias("_d"), F.col("i").alias("j"))
    stop = stop.withColumn("_k", F.row_number().over(Window.partitionBy("_p", "_d").orderBy("j")))
    cards = start.join(stop, (F.col(page) == F.col("_p")) & (F.col("depth") == F.col("_d")) & (F.col("k") == F.col("_k")), "left").drop("_p", "_d", "_k", "k")
    whole = df.select(page, cut.alias("_segs"))
    cards = cards.join(whole, page)
    last = F.coalesce(F.col("j"), F.size("_segs") - 1)
    text = F.array_join(F.slice("_segs", F.col("i") + 1, last - F.col("i") + 1), "")
    inner = F.regexp_replace(F.regexp_replace(text, rf"(?is)^<{tag}[^>]*>", ""), rf"(?is)</{tag}>$", "")
    head = F.regexp_extract("head", r"(?s)^<\w+([^>]*)>", 1)
    out = cards.withColumn("inner", inner)
    if marked:
        out = out.filter(head.rlike(marked))
    return out.select(page, (F.row_number().over(Window.partitionBy(page).orderBy("i")) - 1).alias("card_no"), F.col("depth").cast("int").alias("depth"), "inner")


def links(df: DataFrame, page: str, html: str) -> DataFrame:
    """page, pos, href, name (its text, tags and all) of every link of a page, in order."""
    pattern = r'(?is)<a\b[^>]*href="([^"]*)"[^>]*>(.*?)</a>'
    both = F.arrays_zip(F.regexp_extract_all(F.col(html), F.lit(pattern), F.lit(1)).alias("href"), F.regexp_extract_all(F.col(html), F.lit(pattern), F.lit(2)).alias("name"))
    return df.select(page, F.posexplode(both).alias("pos", "_a")).select(page, "pos", "_a.href", "_a.name")


def lines(inner: Column) -> Column:
    """The text between tags as lines: trimmed, none empty, common entities read."""
    text = F.regexp_replace(inner, "<[^>]*>", "\n")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")


def labelled_number(rows: Column, label: str) -> Column:
    """The number on the line after one that holds the label: its first word, with a decimal comma or point or of digits alone. Of several
    the last; null if there is none or it cannot be read."""
    after = F.transform(rows, lambda x, i: F.when(x.contains(label), F.split(F.get(rows, i + 1), r"\s+")[0]))
    fit = F.filter(after, lambda x: x.isNotNull() & (x.contains(",") | x.contains(".") | x.rlike("^[0-9]+$")))
    return F.replace(F.try_element_at(fit, F.lit(-1)), F.lit(","), F.lit(".")).try_cast("double")


def card_date(rows: Column) -> Column:
    """The first word of the last line with two points whose first word has ten characters ('05.04.2026 Pazar')."""
    fit = F.filter(rows, lambda x: (F.length(x) >= 10) & (F.length(F.regexp_replace(x, r"[^.]", "")) == 2) & (F.length(F.split(x, " ")[0]) == 10))
    return F.split(F.try_element_at(fit, F.lit(-1)), " ")[0]


def price_cards(cards: DataFrame, inner: str = "inner") -> DataFrame:
    """Adds product, low, high and day_text to cards of at least three lines; cards without two prices above 0 go. The lower price first."""
    r = cards.withColumn("_l", lines(F.col(inner))).filter(F.size("_l") >= 3)
    a, b = labelled_number(F.col("_l"), "En Düşük"), labelled_number(F.col("_l"), "En Yüksek")
    r = r.withColumn("_a", a).withColumn("_b", b).filter("_a > 0 and _b > 0")
    return r.select(*[c for c in cards.columns if c != inner], F.col("_l")[0].alias("product"), F.round(F.least("_a", "_b"), 2).alias("low"), F.round(F.greatest("_a", "_b"), 2).alias("high"), card_date(F.col("_l")).alias("day_text"))


def until_repeat(cards: DataFrame, site: str, page: str, text: str) -> DataFrame:
    """Cards of the pages of a site before the first one that shows the same as the page before it, or nothing (a gap in its numbers).
    Pages show the same if the first 60 characters of their cards' texts are the same set."""
    seen = cards.groupBy(site, page).agg(F.array_sort(F.collect_set(F.substring(text, 1, 60))).alias("_s"))
    w = Window.partitionBy(site).orderBy(page)
    again = F.coalesce(F.col("_s") == F.lag("_s").over(w), F.lit(False)) | F.coalesce(F.col(page) - F.lag(page).over(w) > 1, F.lit(False))
    ok = seen.withColumn("_again", again.cast("int")).withColumn("_gone", F.sum("_again").over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("_gone = 0")
    return cards.join(ok.select(F.col(site).alias("_a"), F.col(page).alias("_b")), F.col(site).eqNullSafe(F.col("_a")) & (F.col(page) == F.col("_b")), "left_semi")
