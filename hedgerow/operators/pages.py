"""Links, page chains and file names out of a table of HTML pages, in DataFrame expressions.

Input ``pages(page_id, url, html)``.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hedgerow.functions import text as T
from hedgerow.operators import ordered
from hedgerow.operators.lineage import checkpointed
from hedgerow.rules import documents as D

_TOKEN = r"(?is)<a\b[^>]*>.*?</a\s*>|</?[a-z][^>]*>"  # whole anchors, else single tags
_ANCHOR = r"(?is)^<a\b.*</a\s*>\z"
_HREF = r"(?is)^<a\b[^>]*?\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"


def _classed(words: str, of: str) -> str:
    """Pattern of a tag ``of`` with one of ``words`` in its class."""
    return rf"(?is){of}[^>]*?\sclass\s*=\s*(\"[^\"]*?({words})|'[^']*?({words})|[^\s\"'>]*?({words}))"


def _scanned(tokens: Column) -> Column:
    """(listed, onward): numbers of the anchors that a document list names, and of the one beside the current page or -1.

    One pass in page order. Listed is the first link of each ``li`` in a ``ul`` of class document. The current page is
    the first element of class current or active, ``rel`` elements are open in it, and the first link among its later
    siblings leads on; nothing does once its parent ends (``state`` 2).
    """
    def step(acc, t):
        anchor, close = t.rlike(_ANCHOR), t.startswith("</")
        void = t.rlike(r"(?is)/>\z|^<(area|base|br|col|embed|hr|img|input|link|meta|source|track|wbr)\b") & ~anchor
        linked = anchor & t.rlike(_HREF)
        ul, li = t.rlike(r"(?i)^</?ul\b"), t.rlike(r"(?i)^</?li\b")
        take = linked & acc["wait"] & (acc["ul"] > 0)
        here = (acc["state"] == 0) & t.rlike(_classed("current|active", "<[a-z]"))
        inside = here & anchor & ~t.rlike(_classed("current|active", r"^<a\b"))  # an anchor holds no sibling that is one
        hit = (acc["state"] == 1) & (acc["rel"] == 0) & linked
        ended = (acc["state"] == 1) & (acc["rel"] == 0) & close
        moved = F.when(anchor | void, 0).when(close, -1).otherwise(1)
        return F.struct(
            F.when(inside | hit | ended, 2).when(here, 1).otherwise(acc["state"]).alias("state"),
            F.when(here | (acc["state"] == 1), acc["rel"] + moved).otherwise(acc["rel"]).alias("rel"),
            (acc["n"] + anchor.cast("int")).alias("n"),
            F.when(hit, acc["n"]).otherwise(acc["onward"]).alias("onward"),
            F.when(ul & close, F.greatest(F.lit(0), acc["ul"] - 1))
            .when(ul & ((acc["ul"] > 0) | t.rlike(_classed("document", r"^<ul\b"))), acc["ul"] + 1).otherwise(acc["ul"]).alias("ul"),
            F.when(li, ~close).otherwise(acc["wait"] & ~linked).alias("wait"),
            F.when(take, F.concat(acc["listed"], F.array(acc["n"]))).otherwise(acc["listed"]).alias("listed"))

    start = F.struct(
        F.lit(0).alias("state"), F.lit(0).alias("rel"), F.lit(0).alias("n"), F.lit(-1).alias("onward"), F.lit(0).alias("ul"),
        F.lit(False).alias("wait"), F.array().cast("array<int>").alias("listed"))
    return F.aggregate(tokens, start, step, lambda acc: F.struct(acc["listed"], acc["onward"]))


def page_links(pages: DataFrame) -> DataFrame:
    """Every link of every page: (page_id, url, link_no, href, label, listed, onward); ``label`` is its text without tags.

    Links are counted from 0 in the order of the page; anchors without an address are left out. ``listed``: an entry of
    a document list. ``onward``: the link beside the current page's number. Both take tags as closed where the page
    closes them.
    """
    tokens = pages.select("page_id", "url", F.regexp_extract_all("html", F.lit(_TOKEN), F.lit(0)).alias("_t"))
    scanned = tokens.withColumn("_s", _scanned(F.col("_t")))
    found = scanned.select("page_id", "url", "_s", F.posexplode(F.filter("_t", lambda t: t.rlike(_ANCHOR))).alias("link_no", "_a"))
    href = F.coalesce(*[T.filled(F.regexp_extract("_a", _HREF, n)) for n in (1, 2, 3)])
    label = T.clean_text(F.regexp_replace("_a", r"(?s)<[^>]*>", " "))
    return found.select(
        "page_id", "url", "link_no", href.alias("href"), label.alias("label"), F.array_contains("_s.listed", F.col("link_no")).alias("listed"),
        (F.col("_s.onward") == F.col("link_no")).alias("onward")).filter("href is not null")


def document_links(links: DataFrame) -> DataFrame:
    """Links that lead to a document, by the markers in their address or as entries of a document list.

    ``url_key`` is the whole digest of the address.
    """
    there = T.resolve_url(F.col("href"), F.col("url"))
    return links.filter(F.col("listed") | T.contains_any(F.lower("href"), D.DOCUMENT_LINK_MARKERS)).select(
        "page_id", "link_no", T.url_document_id(there).alias("document_id"), F.md5(there).alias("url_key"),
        F.coalesce(T.filled(F.col("label")), F.lit(D.UNNAMED_DOCUMENT)).alias("description"), there.alias("document_url"))


def next_page_edges(links: DataFrame) -> DataFrame:
    """(page_id, url, next_url): the first link of a page whose text says that it leads to the next one.

    On pages without such a text it is the link beside the current page's number.
    """
    named = F.lower(F.replace("label", F.lit("&gt;"), F.lit(">"))).isin(*D.NEXT_LINK_TEXTS)
    first = links.filter(named | F.col("onward")).groupBy("page_id", "url").agg(F.min_by("href", F.struct(~named, "link_no")).alias("href"))
    return first.select("page_id", "url", T.resolve_url(F.col("href"), F.col("url")).alias("next_url"))


# --- metadata fields --------------------------------------------------------

def field_for_label(label: Column) -> Column:
    """Metadata field a normalised label stands for; null for none."""
    chain = None
    for field, words in D.LABEL_FIELDS:
        hit = T.contains_any(label, words)
        value = F.lit(field)
        if field == "decision":
            hit = hit & ~label.contains("date")
        if field == "applicant":
            value = F.when(~label.contains("agent"), field)
        chain = F.when(hit, value) if chain is None else chain.when(hit, value)
    day = None
    for field, word in D.DATE_FIELDS:
        hit = label.contains("date") & label.contains(word)
        day = F.when(hit, field) if day is None else day.when(hit, field)
    return chain.otherwise(day)


# --- chains -----------------------------------------------------------------

def _doubled(jump: DataFrame, best: bool = False) -> DataFrame:
    """Twice as far along every jump; with ``best`` the least ``low`` on the way is carried along (``fell``: it got less)."""
    columns = [F.col("url").alias("mid"), F.col("next_url").alias("far")]
    far = jump.select(*columns, F.col("low").alias("_low")) if best else jump.select(*columns)
    low = [F.least("low", "_low").alias("low"), (F.col("_low") < F.col("low")).alias("fell")] if best else []
    return checkpointed(jump.join(far, F.col("next_url") == F.col("mid")).select("url", F.col("far").alias("next_url"), *low))


def _without_cycles(step: DataFrame) -> DataFrame:
    """``step`` without the link that closes each cycle, the one to the cycle's smallest address.

    Rounds go by the longest chain, not by the number of links. Past the end of every chain, what is still reached lies on
    a cycle: a doubling from n to 2n steps loses the start that is n links from a chain's end and the target that is n
    links from the start of a tail, so while there is any of them, starts or targets get fewer.
    """
    jump, before = step, None
    while (seen := jump.agg(F.count("*"), F.count_distinct("next_url")).first()) != before:
        jump, before = _doubled(jump), seen
    on_cycle = checkpointed(jump.select(F.col("next_url").alias("url")).distinct())
    if on_cycle.isEmpty():
        return step
    around = step.join(on_cycle, "url", "left_semi").withColumn("low", F.col("url"))
    while True:  # where no stretch's least is less than that of the one before it, all are the cycle's
        around = _doubled(around, best=True)
        if around.filter("fell").isEmpty():
            break
    closing = step.join(around.select("url", "low"), "url").filter("next_url = low").select("url", "next_url")
    return checkpointed(step.join(closing, ["url", "next_url"], "left_anti"))


def page_chains(pages: DataFrame, edges: DataFrame, max_pages: int = None) -> DataFrame:
    """Order of the pages reached from each first page: (first_url, url, step).

    A page nobody points to is a first page, and so is the smallest address of pages that only point at each other.
    Of several edges of a page the one to the smallest address counts. Steps double: after round n every page knows
    the one 2^n steps on. ``max_pages`` ends chains early; there is no limit unless it is given.
    """
    jump = _without_cycles(checkpointed(edges.groupBy("url").agg(F.min("next_url").alias("next_url"))))
    heads = pages.select("url").distinct().join(
        jump.select(F.col("next_url").alias("url")).distinct(), "url", "left_anti")
    reached = checkpointed(heads.select(F.col("url").alias("first_url"), "url", F.lit(1).alias("step")))
    length = 1
    while (max_pages is None or length < max_pages) and not jump.isEmpty():
        onward = reached.join(jump, "url").select(
            "first_url", F.col("next_url").alias("url"), (F.col("step") + length).alias("step"))
        reached = checkpointed(reached.unionByName(onward))
        length *= 2
        jump = _doubled(jump)
    return reached if max_pages is None else reached.filter(F.col("step") <= max_pages)


def number_downloads(docs: DataFrame, by: str = "application_ref", order: str = "seq") -> DataFrame:
    """1-based position and file name of each document of an application."""
    numbered = ordered.position(docs, [by], [order], "download_no", ordered.seq_block(order))
    return numbered.withColumn("file_name", T.safe_file_name(F.col("download_no"), F.col("description")))


def dedupe_names(files: DataFrame, folder: str = "folder", name: str = "file_name", order: str = "seq") -> DataFrame:
    """Second and later files of one name in a folder get ``_1``, ``_2``, ... before the suffix."""
    nth = ordered.position(files, [folder, name], [order], "_nth", ordered.seq_block(order))
    suffix = F.regexp_extract(name, r".(\.[^.]+)\z", 1)
    again = F.concat(T.stem(F.col(name)), F.lit("_"), (F.col("_nth") - 1).cast("string"), suffix)
    return nth.withColumn("stored_name", F.when(F.col("_nth") == 1, F.col(name)).otherwise(again)).drop("_nth")
