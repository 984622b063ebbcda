"""From stored pages to problem records and submissions.

Pages are parsed to an outline once (``page_outline``); all rules below are array
expressions on it. One page is one row from start to end, so extraction needs no
shuffle and no page's parts are ever gathered from elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradus.functions import text as T
from gradus.functions.outline import page_outline
from gradus.sources.schemas import SAMPLE_TESTS

#: Bytes of a part's paragraphs that a row can hold beside their joined text: a Spark
#: row ends at 2 GB.
ROW_BYTES = 1 << 30


def _elements() -> Column:
    return F.col("__outline.elements")


def _first(elements: Column, rule) -> Column:
    return F.get(F.filter(elements, rule), F.lit(0))


def _last(elements: Column, rule) -> Column:
    return F.get(F.reverse(F.filter(elements, rule)), F.lit(0))


def _inside(element: Column) -> Column:
    """Descendants of an element, in document order."""
    return F.slice(_elements(), element["idx"] + 2, element["last"] - element["idx"])


def _tag(name: str, *, cls: str | None = None, id: str | None = None):
    def rule(e: Column) -> Column:
        hit = e["tag"] == name
        if cls is not None:
            hit = hit & F.array_contains(e["classes"], cls)
        if id is not None:
            hit = hit & F.coalesce(e["id"] == id, F.lit(False))
        return hit

    return rule


def _text(element: Column) -> Column:
    """All text within an element."""
    own = F.slice(
        F.col("__outline.pieces"), element["lo"] + 1, element["hi"] - element["lo"]
    )
    return F.array_join(own, "")


def _computed_once(value: Column) -> Column:
    """``value``, as a point below which Spark pushes no filter. A pushed filter
    would repeat the whole computing of ``value``, within lambdas even once per
    element. Non-deterministic expressions are where pushing stops."""
    return F.when(F.monotonically_increasing_id() >= 0, value)


#: Tags that each kind of page is searched for.
PROBLEM_TAGS = ("div", "span", "section", "h3", "p", "pre")
LIST_TAGS = ("tr", "th", "td", "a")
CODE_TAGS = ("pre",)


def _outlined(pages: DataFrame, html: str, tags: tuple[str, ...]) -> DataFrame:
    kept = [c for c in pages.columns if c != html]
    return pages.select(*kept, page_outline(F.col(html), tags).alias("__outline"))


# --- Problem pages -------------------------------------------------------------


def page_parts(
    pages: DataFrame, html: str = "html", statement_only: bool = False
) -> DataFrame:
    """Parse problem pages. One row per page: the other columns of ``pages``,
    ``title`` (null if absent), ``has_statement``, ``has_english``,
    ``parse_error`` and ``parts``, the parts of the English statement in page
    order with what their section holds. With ``statement_only`` no paragraphs of other
    parts are joined. Paragraphs of more than ``ROW_BYTES`` are null and ``overlong``.
    """
    kept = [c for c in pages.columns if c != html]
    scope = _outlined(pages, html, PROBLEM_TAGS).withColumns(
        {
            "__statement": _first(_elements(), _tag("div", id="task-statement")),
            "__title": _first(_elements(), _tag("span", cls="h2")),
        }
    )
    scope = scope.withColumn(
        "__english", _first(_inside(F.col("__statement")), _tag("span", cls="lang-en"))
    )
    heads = scope.withColumn(
        "__heads", F.filter(_inside(F.col("__english")), _tag("div", cls="part"))
    )
    # Next sibling of each part: neighbours once sorted by (parent, position).
    order = heads.withColumn(
        "__order",
        F.array_sort(
            F.transform(
                F.col("__heads"),
                lambda h, i: F.struct(h["parent"].alias("parent"), i.alias("pos")),
            )
        ),
    )

    def with_next(here: Column, i: Column) -> Column:
        following = F.get(F.col("__order"), i + 1)
        return F.struct(
            here["pos"].alias("pos"),
            F.when(following["parent"] == here["parent"], following["pos"]).alias(
                "next"
            ),
        )

    linked = order.withColumn(
        "__links", F.array_sort(F.transform(F.col("__order"), with_next))
    )
    # One step per level of nesting; a lambda would otherwise search the section
    # again for every element it looks at.
    sections = linked.withColumn(
        "__sections",
        F.transform(
            F.col("__heads"), lambda h: _first(_inside(h), _tag("section"))
        ),
    )
    def find_in(head: Column, i: Column) -> Column:
        section = F.get(F.col("__sections"), i)
        return F.struct(
            # First heading of the part, in its section or not.
            _first(_inside(head), _tag("h3")).alias("part_h3"),
            _first(_inside(section), _tag("h3")).alias("h3"),
            F.filter(_inside(section), _tag("p")).alias("p"),
            _first(_inside(section), _tag("div")).alias("div"),
            _first(_inside(section), _tag("pre")).alias("pre"),
        )

    found = sections.withColumn("__found", F.transform(F.col("__heads"), find_in))

    def part(f: Column, i: Column) -> Column:
        header = F.lower(_text(f["h3"]))
        n_bytes = F.aggregate(f["p"], F.lit(0).cast("bigint"), lambda n, p: n + p["size"])
        fits = n_bytes <= ROW_BYTES
        asked = fits & header.contains("problem statement") if statement_only else fits
        return F.struct(
            i.alias("part_idx"),
            F.get(F.col("__links"), i)["next"].alias("next_idx"),
            F.get(F.col("__sections"), i).isNotNull().alias("has_section"),
            header.alias("header"),
            F.lower(_text(f["part_h3"])).alias("part_header"),
            F.when(asked, F.transform(f["p"], _text)).alias("paragraphs"),
            F.coalesce(~fits, F.lit(False)).alias("overlong"),
            _text(f["div"]).alias("content"),
            _text(f["pre"]).alias("sample"),
        )

    return found.select(
        *kept,
        T.strip(_text(F.col("__title"))).alias("title"),
        F.col("__statement").isNotNull().alias("has_statement"),
        F.col("__english").isNotNull().alias("has_english"),
        F.col("__outline.error").alias("parse_error"),
        _computed_once(F.transform(F.col("__found"), part)).alias("parts"),
    )


def part_rows(parsed: DataFrame, *keys: str) -> DataFrame:
    """One row per part, in page order by ``part_idx``."""
    return parsed.select(*keys, F.explode("parts").alias("part")).select(
        *keys, "part.*", section_class(F.col("part")).alias("section_class")
    )


def section_class(part: Column) -> Column:
    """Class of a part by words in its header, first rule that applies; null for
    other headers and for sections without the content their class needs."""
    header = part["header"]
    kind = (
        F.when(header.contains("constraints"), F.lit("constraints"))
        .when(header.contains("input") & header.contains("format"), F.lit("input_format"))
        .when(
            header.contains("output") & header.contains("format"), F.lit("output_format")
        )
    )
    return F.when(header.contains("problem statement"), F.lit("statement")).when(
        part["content"].isNotNull(), kind
    )


def _readable(part: Column) -> Column:
    """A part whose section is looked at to its end. Sections that are not the
    statement and have no ``div`` are left early, with their sample."""
    return part["header"].contains("problem statement") | (
        part["header"].isNotNull() & part["content"].isNotNull()
    )


def _last_of(kind: str) -> Column:
    """The last part of a class; later parts replace earlier ones."""
    return _last(F.col("parts"), lambda p: section_class(p) == kind)


def description() -> Column:
    """Stripped paragraphs of the statement, one per line, empty ones kept."""
    paragraphs = _last_of("statement")["paragraphs"]
    return F.coalesce(
        F.array_join(F.transform(paragraphs, T.strip), "\n"), F.lit("")
    )


def sample_candidates() -> Column:
    """Each sample-input part with the part that follows it."""
    return F.transform(
        F.filter(
            F.col("parts"),
            lambda p: F.coalesce(
                _readable(p) & p["header"].contains("sample input"), F.lit(False)
            ),
        ),
        lambda p: F.struct(
            p["part_idx"].alias("part_idx"),
            p["sample"].alias("input"),
            F.get(F.col("parts"), p["next_idx"]).alias("next"),
        ),
    )


def pair_samples(candidates: Column) -> Column:
    """Stripped input/output pairs in page order."""
    return F.transform(
        F.filter(
            candidates,
            lambda s: F.coalesce(
                s["next"]["part_header"].contains("sample output")
                & s["input"].isNotNull()
                & s["next"]["sample"].isNotNull(),
                F.lit(False),
            ),
        ),
        lambda s: F.struct(
            T.strip(s["input"]).alias("input"),
            T.strip(s["next"]["sample"]).alias("output"),
        ),
    ).cast(SAMPLE_TESTS)


def _sample_error(candidates: Column) -> Column:
    """Why pairing fails on a page, or null: the part after a sample input has no
    heading, or is a sample output without a section."""

    def fault(s: Column) -> Column:
        following = s["next"]
        return F.when(
            following.isNotNull() & following["part_header"].isNull(),
            F.concat(F.lit("no heading after sample input in part "), s["part_idx"]),
        ).when(
            following["part_header"].contains("sample output")
            & ~following["has_section"],
            F.concat(F.lit("no section after sample input in part "), s["part_idx"]),
        )

    faults = F.filter(F.transform(candidates, fault), lambda f: f.isNotNull())
    return F.get(faults, F.lit(0))


def problem_records(parsed: DataFrame) -> DataFrame:
    """Problem fields per parsed page, plus ``error`` for pages that cannot be
    read. Pages without statement, English text or title are no problems and
    are dropped."""
    keys = [
        c
        for c in parsed.columns
        if c not in ("title", "has_statement", "has_english", "parse_error", "parts")
    ]
    usable = (
        F.col("has_statement") & F.col("has_english") & F.col("title").isNotNull()
    ) | F.col("parse_error").isNotNull()
    staged = parsed.where(usable).withColumn("__samples", sample_candidates())

    def section(kind: str) -> Column:
        return F.coalesce(T.strip(_last_of(kind)["content"]), F.lit("")).alias(kind)

    return staged.select(
        *keys,
        "title",
        description().alias("description"),
        section("constraints"),
        section("input_format"),
        section("output_format"),
        pair_samples(F.col("__samples")).alias("sample_tests"),
        F.coalesce(
            F.col("parse_error"),
            F.when(
                _last_of("statement")["overlong"],
                F.lit("text of paragraphs within one another is too long for a row"),
            ),
            _sample_error(F.col("__samples")),
        ).alias("error"),
    )


def quarantine(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split rows into good ones and dead letters (with ``error``). Store or
    materialise ``df`` first if both sides are used."""
    failed = F.col("error").isNotNull()
    return df.where(~failed).drop("error"), df.where(failed)


# --- Submission pages ----------------------------------------------------------


def listed_submissions(pages: DataFrame, html: str = "html") -> DataFrame:
    """Parse submission lists. One row per page: ``rows``, the table rows in
    order as (row_idx, is_header, has_cell, href of the last cell's first link,
    '' without one)."""
    kept = [c for c in pages.columns if c != html]
    rows = _outlined(pages, html, LIST_TAGS).withColumn(
        "__rows", F.filter(_elements(), _tag("tr"))
    )
    cells = rows.withColumn(
        "__cells",
        F.transform(
            F.col("__rows"),
            lambda r: F.struct(
                (F.size(F.filter(_inside(r), _tag("th"))) > 0).alias("is_header"),
                _last(_inside(r), _tag("td")).alias("cell"),
            ),
        ),
    )
    return cells.select(
        *kept,
        F.col("__outline.error").alias("parse_error"),
        _computed_once(
            F.transform(
                F.col("__cells"),
                lambda c, i: F.struct(
                    i.alias("row_idx"),
                    c["is_header"].alias("is_header"),
                    c["cell"].isNotNull().alias("has_cell"),
                    F.coalesce(
                        _first(_inside(c["cell"]), _tag("a"))["href"], F.lit("")
                    ).alias("href"),
                ),
            )
        ).alias("rows"),
    )


def submission_rows(listed: DataFrame, *keys: str) -> DataFrame:
    """One row per listed submission that has a link."""
    return (
        listed.select(*keys, F.explode("rows").alias("r"))
        .where(~F.col("r.is_header") & (F.col("r.href") != ""))
        .select(
            *keys,
            "r.row_idx",
            "r.href",
            F.substring_index("r.href", "/", -1).alias("submission_id"),
        )
    )


def first_listed(listed: DataFrame) -> DataFrame:
    """First submission of each list page: ``submission_id`` (null if there is
    none) and ``error`` if a row without cells comes before it."""
    keys = [c for c in listed.columns if c not in ("rows", "parse_error")]
    body = listed.withColumn(
        "__stop",
        _first(
            F.col("rows"),
            lambda r: ~r["is_header"] & ((r["href"] != "") | ~r["has_cell"]),
        ),
    )
    stop = F.col("__stop")
    last_segment = F.substring_index(stop["href"], "/", -1)
    return body.select(
        *keys,
        F.when(stop["has_cell"] & (last_segment != ""), last_segment).alias(
            "submission_id"
        ),
        F.coalesce(
            F.col("parse_error"),
            F.when(
                ~stop["has_cell"],
                F.concat(F.lit("no cell in list row "), stop["row_idx"]),
            ),
        ).alias("error"),
    )


def submission_code(pages: DataFrame, html: str = "html") -> DataFrame:
    """Source text of submission pages as ``solution``; null if absent."""
    kept = [c for c in pages.columns if c != html]
    code = _first(_elements(), _tag("pre", id="submission-code"))
    return (
        _outlined(pages, html, CODE_TAGS)
        .withColumn("__code", code)
        .select(
            *kept,
            T.strip(_text(F.col("__code"))).alias("solution"),
            F.col("__outline.error").alias("error"),
        )
    )
