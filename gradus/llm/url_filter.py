"""URL filter: rules first, then the ratio of two character language models.

Rules that name a host and a path decide the URLs they fit. Those URLs teach two
models, one of accepted and one of rejected URLs: Markov models of characters whose
order varies. The chance of a character after the ``ORDER`` characters before it is
smoothed from order 0 upwards: each context adds its own counts, weighted by how
often and with how many different characters it was seen (Witten and Bell). A URL's
score is the mean log-likelihood difference per character, so long URLs aren't
favoured. The threshold is calibrated on a fifth of the ruled URLs, by their id,
that the models don't learn from: it is the score at which the two classes' normal
distributions meet in balance.

Counts are sums over all URLs. The chance of a character depends only on itself and
the ``ORDER`` before it, so it is worked out once per distinct string of that
length, not per URL, and joined back; in the same way, each order works on its own
distinct strings and takes the chances of the order below, so a key of its joins has
no more rows than there are characters. Counts are summed before they are shuffled.

Nothing is broadcast, and every join says so: Spark takes a stored table for as large
as its compressed files, and what is exploded from it for no larger, so it would bring
all the strings of all URLs to the driver. Strings are joined under a number of their
URL, not under its text.

Defined results: a null URL, or one without ``://``, has an empty host and path and
is scored as such; without examples of a class, or without spread, the threshold is
0; a score equal to the threshold is allowed; null ids and repeated rows are kept; an
empty table gives an empty one; extra columns are ignored. A URL of any length is
scored whole, in time linear in its length and with one small string per character in
the task's memory.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradus.llm.common import crc_mod, stored

#: Characters of context at most.
ORDER = 5
#: Pads the beginning, so that the first characters have a context too.
PAD = "\x02"
END = "\x03"
#: Distinct characters that a model expects before it has seen any.
ALPHABET = 256
HELD_OUT = 5

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return f"{self.host}{self.path}"

    def fits(self) -> Column:
        host = (F.col("host") == self.host) | F.endswith("host", F.lit(f".{self.host}"))
        return host & F.startswith("path", F.lit(self.path))


RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))
    host = F.regexp_extract(rest, r"\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    empty = F.lit("")
    return (
        F.coalesce(F.translate(host, _UPPER, _UPPER.lower()), empty),
        F.coalesce(path, empty),
    )


def ruled(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``page_id, host, path, rule, ruled``: the longest rule that fits."""
    host, path = host_and_path(F.col("url"))
    out = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.name)):
        rule = F.when(r.fits(), F.lit(r.name)).otherwise(rule)
        verdict = F.when(r.fits(), F.lit(r.verdict)).otherwise(verdict)
    return out.select("*", rule.alias("rule"), verdict.alias("ruled"))


def grams(text: Column) -> Column:
    """Every character of the text with the ``ORDER`` before it, and the end. The
    characters are cut apart once and picked by place, so the work is linear in the
    text's length."""
    padded = F.concat(F.lit(PAD * ORDER), text, F.lit(END))
    # Bound by an outer transform: a column would be cut again for every place.
    return F.get(
        F.transform(
            F.array(F.split(padded, "")),
            lambda characters: F.transform(
                F.sequence(F.lit(0), F.length(text)),
                lambda i: F.concat(*(F.get(characters, i + k) for k in range(ORDER + 1))),
            ),
        ),
        F.lit(0),
    )


def _merged(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Joined by sorting both, whatever size Spark takes them for."""
    return left.hint("merge").join(right.hint("merge"), key)


def _chances(counted: DataFrame) -> DataFrame:
    """``gram, ratio``: log chance of its last character among accepted URLs less
    that among rejected ones. ``counted``: ``gram, allow, block``."""
    for order in range(ORDER + 1):
        tail = F.substr(F.col("gram"), F.lit(ORDER + 1 - order)).alias("tail")
        by = counted.groupBy(tail).agg(F.sum("allow").alias("allow"), F.sum("block").alias("block"))
        context = Window.partitionBy(F.substr(F.col("tail"), F.lit(1), F.length("tail") - 1))
        by = by.select(
            "*",
            *(F.sum(c).over(context).alias(f"n_{c}") for c in ("allow", "block")),
            *(F.count_if(F.col(c) > 0).over(context).alias(f"t_{c}") for c in ("allow", "block")),
        )
        if order:
            shorter = out.withColumnRenamed("tail", "shorter")
            by = _merged(by.withColumn("shorter", F.substr("tail", F.lit(2))), shorter, "shorter")
        else:
            by = by.select("*", *(F.lit(1.0 / ALPHABET).alias(f"p_{c}") for c in ("allow", "block")))
        smooth = {
            c: F.when(
                F.col(f"n_{c}") > 0,
                (F.col(c) + F.col(f"t_{c}") * F.col(f"p_{c}"))
                / (F.col(f"n_{c}") + F.col(f"t_{c}")),
            ).otherwise(F.col(f"p_{c}"))
            for c in ("allow", "block")
        }
        out = by.select("tail", *(v.alias(f"p_{c}") for c, v in smooth.items()))
        if order % 2:
            out = stored(out, "chances")
    return out.select(F.col("tail").alias("gram"), (F.ln("p_allow") - F.ln("p_block")).alias("ratio"))


def _threshold(scored: DataFrame) -> float:
    """Where the held-out classes' normal distributions are equally far, in standard
    deviations, from their means."""
    rows = scored.groupBy("ruled").agg(
        F.avg("score").alias("m"), F.coalesce(F.stddev_pop("score"), F.lit(0.0)).alias("s")
    )
    by = {r["ruled"]: r for r in rows.collect()}  # two rows
    if set(by) != {"allow", "block"} or by["allow"]["m"] <= by["block"]["m"]:
        return 0.0
    a, b = by["allow"], by["block"]
    spread = a["s"] + b["s"]
    return (a["m"] * b["s"] + b["m"] * a["s"]) / spread if spread else 0.0


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict, score`` of every row."""
    urls = stored(ruled(pages, rules), "urls")
    # One row per distinct URL and verdict; copies only add to the counts.
    text = F.concat("host", "path").alias("text")
    learns = F.coalesce(crc_mod(F.col("page_id"), HELD_OUT) != 0, F.lit(True))
    texts = urls.groupBy(text).agg(
        F.count_if((F.col("ruled") == "allow") & learns).alias("allow"),
        F.count_if((F.col("ruled") == "block") & learns).alias("block"),
    )
    texts = stored(texts.withColumn("number", F.monotonically_increasing_id()), "texts")
    counted = stored(
        texts.select("allow", "block", F.explode(grams(F.col("text"))).alias("gram"))
        .groupBy("gram")
        .agg(F.sum("allow").alias("allow"), F.sum("block").alias("block")),
        "grams",
    )
    ratios = _chances(counted)
    parts = texts.select("number", F.explode(grams(F.col("text"))).alias("gram"))
    scores = _merged(parts, ratios, "gram").groupBy("number").agg(
        # Whole millionths add up to the same in any order.
        (F.sum(F.round(F.col("ratio") * 1e6).cast("long")) / F.count(F.lit(1)) / 1e6).alias("score")
    )
    # Stored, so that Spark can split the rows of a frequent text.
    scores = stored(
        _merged(texts.select("number", "text"), scores, "number").select("text", "score"), "scores"
    )
    scored = stored(
        _merged(urls.withColumn("text", F.concat("host", "path")), scores, "text"), "scored"
    )
    cut = _threshold(scored.where(F.col("ruled").isNotNull()).where(~learns))
    method = F.when(F.col("score") >= cut, "allow").otherwise("block")
    return scored.select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("ruled", method).alias("verdict"),
        "score",
    )
