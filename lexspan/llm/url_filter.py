"""URL filters by a temporal list join; built-in functions only.

List entries carry the time from which they hold. Sorted by time, the entries of one
pattern become validity intervals: each holds until the next. A capture is judged by
the entries that are active at its fetch time, by an as-of join on every pattern that
could match it: its host and parent domains, and its path's prefixes. The most specific
pattern with an active entry decides.

A pattern of a hot host may have a third of all captures and of all entries, so neither
meets in one task: times of one pattern are dealt in spans of an hour. Captures are
reduced to distinct (pattern, time) first, so an hour of a pattern holds 3,600 times and
its entries; what was active when an hour began is found on one row for each hour of a
pattern.

Cases: a null or unreadable URL, or a missing fetch time, matches nothing (`none`); of
entries of one pattern and time `block` goes before `allow` before `remove`; an entry
holds from its very second on; entries without pattern, time or action are ignored;
repeated captures each get a row; empty tables give `none` or no rows; captures keep
their other columns, and columns named like the results are replaced.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspan.llm.scratch import let, stored

#: Seconds of one pattern that are dealt to one group.
SPAN = 3600
# What an entry can say, weakest first.
ACTIONS = ("remove", "allow", "block")
AUTHORITY = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:@]*)"
PATH = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*([^?#]*)"


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, AUTHORITY, 1))


def patterns_of(url: Column) -> Column:
    """Array of (pattern, weight): all that could match, heavier being more specific.

    A domain's pattern is its name; a path's is host and path prefix, ending in `/`.
    """
    segments = F.filter(F.split(F.regexp_extract(url, PATH, 1), "/"), lambda s: s != "")
    none = F.from_json(F.lit("[]"), "array<struct<pattern:string,weight:int>>")

    def domains(labels: Column) -> Column:
        last = F.size(labels)
        return F.transform(F.sequence(F.lit(1), last), lambda k: F.struct(F.array_join(F.slice(labels, last - k + 1, k), ".").alias("pattern"), k.alias("weight")))

    def paths(state: Column) -> Column:
        host, parts = state["host"], state["parts"]
        steps = F.when(F.size(parts) > 0, F.sequence(F.lit(1), F.size(parts))).otherwise(F.array().cast("array<int>"))
        return F.transform(steps, lambda k: F.struct(F.concat(host, F.lit("/"), F.array_join(F.slice(parts, 1, k), "/"), F.lit("/")).alias("pattern"), (k + 1000).alias("weight")))

    host = host_of(url)
    both = F.concat(let(F.split(host, r"\."), domains), let(F.struct(host.alias("host"), segments.alias("parts")), paths))
    return F.when(F.coalesce(host, F.lit("")) == "", none).otherwise(both)


def intervals(entries: DataFrame) -> DataFrame:
    """pattern, action, say, valid_from, valid_to (null: for good) of pattern, action, listed_at.

    An entry ends where the next of its pattern begins: in its own hour, else the first of the
    pattern's next hour that has one, so a window over a pattern holds a row for each hour.
    """
    settled = _settled(entries).withColumn("hour", F.floor(F.col("valid_from") / SPAN))
    hours = settled.groupBy("pattern", "hour").agg(F.min("valid_from").alias("opens"))
    ends = hours.select("pattern", "hour", F.lead("opens").over(Window.partitionBy("pattern").orderBy("hour")).alias("later"))
    inside = settled.withColumn("next", F.lead("valid_from").over(Window.partitionBy("pattern", "hour").orderBy("valid_from")))
    action = F.element_at(F.array(*[F.lit(a) for a in ACTIONS]), F.col("say") + 1)
    return inside.join(ends, ["pattern", "hour"]).select(
        "pattern", action.alias("action"), "say", "valid_from", F.coalesce("next", "later").alias("valid_to"))


def _settled(entries: DataFrame) -> DataFrame:
    """One entry for each pattern and time: pattern, valid_from (seconds), say (index of its action)."""
    say = F.array_position(F.array(*[F.lit(a) for a in ACTIONS]), F.col("action")).cast("int") - 1
    known = entries.where(F.col("pattern").isNotNull() & F.col("listed_at").isNotNull() & F.col("action").isin(*ACTIONS))
    return known.select("pattern", F.unix_timestamp("listed_at").alias("valid_from"), say.alias("say")).groupBy("pattern", "valid_from").agg(F.max("say").alias("say"))


def as_of(probes: DataFrame, spans: DataFrame) -> DataFrame:
    """say, valid_from of the interval of `pattern` that holds `at`, for distinct probes.

    The intervals of one pattern do not overlap, so only the last that began can hold a time.
    """
    hour = lambda c: F.floor(F.col(c) / SPAN).alias("hour")
    span = F.struct("valid_from", "say", "valid_to")
    both = spans.select("pattern", hour("valid_from"), F.col("valid_from").alias("at"), F.lit(False).alias("asks"), span.alias("span")).unionByName(
        probes.select("pattern", hour("at"), "at", F.lit(True).alias("asks"), F.lit(None).cast("struct<valid_from:bigint,say:int,valid_to:bigint>").alias("span"))
    )
    # The last interval that began before each hour of a pattern: one row an hour.
    hours = both.groupBy("pattern", "hour").agg(F.max("span").alias("last"))
    earlier = Window.partitionBy("pattern").orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)
    carried = hours.select(F.col("pattern").alias("pattern_"), F.col("hour").alias("hour_"), F.last("last", ignorenulls=True).over(earlier).alias("carried"))
    upto = Window.partitionBy("pattern", "hour").orderBy("at", "asks").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = both.withColumn("within", F.last("span", ignorenulls=True).over(upto)).where("asks")
    found = inside.join(carried, (F.col("pattern") == F.col("pattern_")) & (F.col("hour") == F.col("hour_")))
    holds = F.col("span").isNotNull() & (F.col("span.valid_to").isNull() | (F.col("at") < F.col("span.valid_to")))
    return found.select("pattern", "at", F.coalesce("within", "carried").alias("span")).where(holds).select("pattern", "at", "span.valid_from", "span.say")


def judge(captures: DataFrame, entries: DataFrame, url: str = "url", fetched_at: str = "fetched_at") -> DataFrame:
    """Add host, action (block, allow or none), pattern and listed_at of the entry that decides."""
    asked = captures.select(F.col(url).alias("url_"), F.unix_timestamp(fetched_at).alias("at")).where("url_ is not null and at is not null").distinct()
    could = stored(asked.select("url_", "at", F.inline(patterns_of(F.col("url_")))), "patterns")
    # What was removed is a gap between intervals.
    spans = stored(intervals(entries).where(F.col("say") > 0).drop("action"), "intervals")
    active = as_of(could.select("pattern", "at").distinct(), spans)
    best = could.join(active, ["pattern", "at"]).groupBy("url_", "at").agg(F.max(F.struct("weight", "pattern", "say", "valid_from")).alias("best"))
    # Stored, so that the join below shuffles both sides and can split a capture that is often repeated.
    verdicts = stored(best.select("url_", F.col("at").alias("at_"), "best"), "verdicts")
    clean = captures.drop("host", "action", "pattern", "listed_at")
    joined = clean.join(verdicts, (F.col(url) == F.col("url_")) & (F.unix_timestamp(fetched_at) == F.col("at_")), "left")
    says = F.element_at(F.array(*[F.lit(a) for a in ACTIONS]), F.col("best.say") + 1)
    return joined.withColumns({
        "host": host_of(F.col(url)),
        "action": F.when(F.col("best").isNotNull(), says).otherwise("none"),
        "pattern": F.col("best.pattern"),
        "listed_at": F.timestamp_seconds("best.valid_from"),
    }).drop("url_", "at_", "best")
