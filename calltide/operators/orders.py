"""Orders written as Markdown sections, parsed by column expressions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calltide.functions.text import col, collapse_space, let, lines, ordinal, paragraphs, strip, strip_right

#: The sections of an order, in their order, the default texts and the shapes of headers and sign-offs.
SECTIONS = ("Situation", "Intent", "Main Effort", "Supporting Effort", "Reserves & Fallback")
UNREAD = "All clear — board fully readable."
ACKNOWLEDGED = "— Acknowledged."
_HEADER = r"^##\s+(.+?)\s*$"
_TAIL = r"(?:^|\n|\s)(—\s*Acknowledged[^\n]*?)\s*$"


def sections(md: Column | str) -> Column:
    """map of lower-case '## ' headers to stripped bodies; text before the first is left out, of equal headers the last holds."""

    def entries(marked: Column, at: Column) -> Column:
        key = lambda i: F.lower(strip(F.regexp_extract(F.get(marked, i), _HEADER, 1)))
        body = lambda i, k: strip(F.array_join(F.slice(marked, i + 2, F.coalesce(F.get(at, k + 1), F.size(marked)) - i - 1), "\n"))
        return F.transform(at, lambda i, k: F.struct(key(i).alias("key"), body(i, k).alias("value")))

    headers = lambda marked: F.filter(F.transform(marked, lambda x, i: F.when(x.rlike(_HEADER), i)), lambda i: i.isNotNull())
    found = let(F.transform(lines(md), strip_right), lambda marked: let(headers(marked), lambda at: entries(marked, at)))
    ordered = F.array_sort(F.transform(found, lambda e, k: F.struct(e["key"].alias("key"), k.alias("place"), e["value"].alias("value"))))
    last = let(ordered, lambda e: F.filter(e, lambda x, k: ~F.get(e, k + 1)["key"].eqNullSafe(x["key"])))
    return F.map_from_entries(F.transform(last, lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"))))


def bullets(body: Column | str) -> Column:
    """Bulleted items, each with the lines that follow it; lines before any bullet make one item."""
    items = F.filter(F.transform(lines(body), strip), lambda x: x != "")
    mark = r"^[-*+]\s+(.+)$"
    # one text in which each bullet begins with a character that lines can't hold, then split there
    marked = F.transform(items, lambda x, k: F.when(x.rlike(mark), F.concat(F.lit("\x1e"), strip(F.regexp_extract(x, mark, 1)))).otherwise(F.concat(F.when(k == 0, "").otherwise(" "), x)))
    return F.filter(F.split(F.array_join(marked, ""), "\x1e"), lambda x: x != "")


def parse(docs: DataFrame, md: str = "md") -> DataFrame:
    """``docs`` with ``orders``: struct(see_board, unread, sections[n, title, body], ack).

    Absent sections are left out, an absent 'unread' has its default text, and an acknowledgment at the end of the last
    section is taken for the missing one.
    """
    of = lambda name: F.coalesce(F.try_element_at("__sections", F.lit(name)), F.lit(""))
    # the map is an own projection, so that it is made once a row
    rows = docs.withColumn("__sections", sections(md))
    found = F.array(*(F.struct(ordinal(F.lit(k)).alias("n"), F.lit(title).alias("title"), paragraphs(of(title.lower())).alias("body")) for k, title in enumerate(SECTIONS, 1)))
    rows = rows.select("*", F.filter(found, lambda s: F.size(s["body"]) > 0).alias("__found"), collapse_space(F.coalesce(F.nullif(strip(of("unread")), F.lit("")), F.lit(UNREAD))).alias("__unread"), collapse_space(strip(of("acknowledged"))).alias("__ack"))
    rows = rows.withColumn("__tail", F.try_element_at(F.try_element_at("__found", F.lit(-1))["body"], F.lit(-1)))
    recovered = F.when((F.col("__ack") == "") & F.coalesce(F.col("__tail").rlike(_TAIL), F.lit(False)), strip(F.regexp_extract("__tail", _TAIL, 1)))
    rows = rows.withColumn("__recovered", recovered).withColumn("__rest", F.regexp_replace(F.regexp_replace("__tail", _TAIL, ""), "[ \n—]+$", ""))
    last = F.element_at("__found", -1)
    body = F.concat(F.slice(last["body"], F.lit(1), F.size(last["body"]) - 1), F.when(F.col("__rest") != "", F.array("__rest")).otherwise(F.array().cast("array<string>")))
    changed = F.concat(F.slice("__found", F.lit(1), F.size("__found") - 1), F.array(F.struct(last["n"].alias("n"), last["title"].alias("title"), body.alias("body"))))
    orders = F.struct(
        F.coalesce(bullets(of("what i see on the board")), F.array().cast("array<string>")).alias("see_board"), F.col("__unread").alias("unread"),
        F.when(F.col("__recovered").isNotNull(), changed).otherwise(F.col("__found")).alias("sections"), F.coalesce("__recovered", F.nullif("__ack", F.lit("")), F.lit(ACKNOWLEDGED)).alias("ack"),
    )
    return rows.select(*docs.columns, orders.alias("orders"))


def intent(orders: Column | str = "orders") -> Column:
    """The first paragraph of the Intent section, or empty."""
    own = F.filter(col(orders)["sections"], lambda s: s["title"] == "Intent")
    return F.coalesce(F.try_element_at(F.try_element_at(own, F.lit(1))["body"], F.lit(1)), F.lit(""))
