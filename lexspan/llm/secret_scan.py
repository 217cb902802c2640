"""Secret scans: fixed patterns, and Markov models of random strings; built-in functions only.

Base spans come from three patterns. Further spans are long runs of key characters that
look random: a character Markov model of random strings and one of ordinary identifiers
are trained from labelled samples. Random are the values that the base patterns find
and a digest of each sampled text, in hexadecimal and in base 64, and all of them in
capitals too; ordinary are the other runs of letters and digits. A run is a secret if
the log-likelihood ratio of its character pairs, per pair, passes a threshold. The log
ratios are whole thousandths, so sums don't depend on their order.

Positions count code points: a text is split at the matches of a pattern, and the
lengths of what lies between and of the matches add up to starts and ends. Work grows
with a text's length and the number of its spans, not with their product: lists are
built in blocks, overlaps are found by bisection, and a text is masked from blocks of
its own.

Cases: a null text has no spans, as an empty one; a row is scanned by itself, so
repeated rows and missing ids need no care; an empty table, or one without samples,
gives models that know nothing and add no spans; columns named like the
results are replaced.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspan.llm.scratch import fresh, let

# The patterns of the base spans.
KINDS = ("assign", "access", "hex", "markov")
KEYWORDS = r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
ASSIGN = KEYWORDS + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
# Runs that the models judge, and the alphabet of their pairs.
RUN = r"[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-."
#: Runs of this many characters are samples of ordinary identifiers.
SAMPLE_RUN = r"[A-Za-z0-9_]{8,}"
#: Documents from which the models learn, about: those whose id hashes lowest.
SAMPLE = 20_000
#: Thousandths of a log-likelihood ratio that a character pair of a secret must have on average.
THRESHOLD = 1000


def _pieces(text: Column, pattern: str) -> tuple[Column, Column]:
    """Whole matches of a pattern, and what lies before, between and after them."""
    return F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)), F.split(text, pattern, -1)


SPANS = "array<struct<start:int,end:int,value:string>>"
#: Spans, and code points, in a block.
BLOCK = 512


def _none(kind: str) -> Column:
    return F.from_json(F.lit("[]"), kind)


def _listed(items: Column, kind: str, step: Callable[[Column, Column], Column]) -> Column:
    """Spans that `step` appends to (at, spans) from item to item.

    An array grows by copying it, so it grows within blocks, which are put together last.
    """
    count = F.size(items)
    blocks = F.when(count > 0, F.transform(F.sequence(F.lit(0), ((count - 1) / BLOCK).cast("int")), lambda b: F.slice(items, b * BLOCK + 1, F.lit(BLOCK)))).otherwise(
        F.slice(F.array(items), 1, 0))

    def block(state: Column, some: Column) -> Column:
        inner = F.aggregate(some, F.struct(state["at"].alias("at"), _none(kind).alias("spans")), step)
        return let(inner, lambda x: F.struct(x["at"].alias("at"), F.concat(state["out"], F.array(x["spans"])).alias("out")))

    begin = F.struct(F.lit(0).alias("at"), _none(f"array<{kind}>").alias("out"))
    return F.aggregate(blocks, begin, block, lambda state: F.flatten(state["out"]))


def _located(found: Column, between: Column) -> Column:
    """Array of (start, end, value): where each match lies, in code points."""
    def step(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["gap"])
        end = start + F.length(x["value"])
        spot = F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value"))
        # What lies after the last match has no match beside it.
        return F.when(x["value"].isNull(), state).otherwise(F.struct(end.alias("at"), F.concat(state["spans"], F.array(spot)).alias("spans")))

    return let(F.arrays_zip(found.alias("value"), between.alias("gap")), lambda items: _listed(items, SPANS, step))


def _touches(spans: Column, s: Column) -> Column:
    """Whether one of `spans`, which ascend and lie apart, overlaps `s`: the last that starts before its end would."""
    count = F.size(spans)
    steps = F.sequence(F.lit(1), F.ceil(F.log2(count + 1)).cast("int") + 1)
    # Invariant: the spans below `low` start before the end of `s`, those from `high` on don't.
    def halve(state: Column, _: Column) -> Column:
        middle = ((state["low"] + state["high"]) / 2).cast("int")
        before = F.get(spans, middle)["start"] < s["end"]
        return F.when(state["low"] >= state["high"], state).when(before, F.struct((middle + 1).alias("low"), state["high"].alias("high"))).otherwise(
            F.struct(state["low"].alias("low"), middle.alias("high")))

    last = F.aggregate(steps, F.struct(F.lit(0).alias("low"), count.alias("high")), halve, lambda state: state["low"] - 1)
    return (count > 0) & let(last, lambda at: (at >= 0) & (F.get(spans, at)["end"] > s["start"]))


def spans_of(text: Column, pattern: str) -> Column:
    """Located matches of a pattern; texts without one are passed over quickly."""
    found, between = _pieces(text, pattern)
    return F.when(text.rlike(pattern), _located(found, between)).otherwise(F.from_json(F.lit("[]"), SPANS))


def base_spans(text: Column) -> dict[str, Column]:
    """The spans of each base kind."""
    # A run that fails the least length matches nothing longer from within itself, so the
    # length can stand in the pattern; not so for `assign`, whose failing matches use up text.
    return {
        "assign": F.filter(spans_of(text, ASSIGN), lambda s: F.length(F.regexp_extract(s["value"], f"^{ASSIGN}$", 2)) >= LEAST_ASSIGN),
        "access": spans_of(text, f"AKIA[A-Z0-9]{{{LEAST_ACCESS - 4},}}"),
        "hex": spans_of(text, f"[0-9a-f]{{{LEAST_HEX},}}"),
    }


def _pairs(values: DataFrame, value: str = "value") -> DataFrame:
    """Rows of neighbouring characters, as a two-character string."""
    steps = F.sequence(F.lit(1), F.length(value) - 1)
    return values.where(F.length(value) > 1).select("kind", F.explode(steps).alias("i"), F.col(value).alias("v")).select("kind", F.expr("substring(v, i, 2)").alias("pair"))


def sample(df: DataFrame, doc_id: str, size: int = SAMPLE) -> DataFrame:
    """About `size` rows, those of the lowest hashed ids; all, if there are no more."""
    total = df.count()
    if total <= size:
        return df
    return df.where(F.substring(F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), 1, 8) < f"{size * (1 << 32) // total:08x}")


def train(df: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SAMPLE) -> dict[str, int]:
    """Log ratio, in thousandths, of each pair of characters that the samples hold.

    The result has at most the square of the alphabet's size entries.
    """
    picked = sample(df.select(doc_id, text), doc_id, size).select(F.coalesce(F.col(text), F.lit("")).alias("t"))
    base = base_spans(F.col("t"))
    secrets = F.concat(
        F.transform(base["assign"], lambda s: F.regexp_extract(s["value"], f"^{ASSIGN}$", 2)),
        F.transform(base["access"], lambda s: s["value"]),
        F.transform(base["hex"], lambda s: s["value"]),
    )
    ordinary = F.regexp_extract_all("t", F.lit(f"({SAMPLE_RUN})"), F.lit(1))
    digest = F.sha2(F.col("t").cast("binary"), 256)
    more = F.array(digest, F.rtrim(F.translate(F.base64(F.unhex(digest)), "=", "")))
    both = picked.select(F.concat(secrets, more).alias("s"), ordinary.alias("o"))
    random = both.select(F.lit("random").alias("kind"), F.explode(F.concat("s", F.transform("s", F.upper))).alias("value"))
    # What a base pattern found is no ordinary identifier.
    plain = both.select(F.lit("plain").alias("kind"), F.explode(F.array_except("o", "s")).alias("value"))
    counts = _pairs(random).unionByName(_pairs(plain)).groupBy("pair").agg(F.count_if(F.col("kind") == "random").alias("r"), F.count_if(F.col("kind") == "plain").alias("p"))
    inside = [c for c in ALPHABET]
    first = F.substring("pair", 1, 1)
    known = counts.where(first.isin(inside) & F.substring("pair", 2, 1).isin(inside)).select(first.alias("first"), "pair", "r", "p")
    totals = known.groupBy("first").agg(F.sum("r").alias("rt"), F.sum("p").alias("pt"))
    size_ = len(ALPHABET)
    ratio = F.ln(((F.col("r") + 0.5) / (F.col("rt") + 0.5 * size_)) / ((F.col("p") + 0.5) / (F.col("pt") + 0.5 * size_)))
    rows = known.join(totals, "first").select("pair", F.round(ratio * 1000).cast("int").alias("score")).collect()
    return {row.pair: row.score for row in rows}


def scan(df: DataFrame, model: dict[str, int], text: str = "text", threshold: int = THRESHOLD, out: str = "found") -> DataFrame:
    """Add `out`: array of (kind, start, end) by start, then kind in the order of KINDS."""
    whole = F.coalesce(F.col(text), F.lit(""))
    base = base_spans(whole)
    held = {kind: fresh(kind) for kind in base}
    near, runs = {kind: F.col(name) for kind, name in held.items()}, fresh("runs")
    marked = df.withColumns({held[kind]: spans for kind, spans in base.items()}).withColumn(runs, spans_of(whole, RUN))
    side = len(ALPHABET) + 1
    table = [0] * (side * side)
    for pair, score in model.items():
        table[(ALPHABET.index(pair[0]) + 1) * side + ALPHABET.index(pair[1]) + 1] = score
    weights = F.split(F.lit(",".join(map(str, table))), ",").cast("array<int>")

    def looks_random(s: Column) -> Column:
        def code(i: Column) -> Column:
            return F.instr(F.lit(ALPHABET), F.substring(s["value"], i, F.lit(1)))

        steps = F.sequence(F.lit(1), F.length(s["value"]) - 1)
        total = F.aggregate(steps, F.lit(0), lambda sum_, i: sum_ + F.get(weights, code(i) * side + code(i + 1)))
        return (total >= threshold * (F.length(s["value"]) - 1)) if model else F.lit(False)

    def free(s: Column) -> Column:
        taken = F.lit(False)
        for kind in base:
            taken = taken | _touches(near[kind], s)
        return ~taken

    added = F.filter(runs, lambda s: free(s) & looks_random(s))

    def ranked(spans: Column, kind: int) -> Column:
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end")))

    parts = [ranked(spans, kind) for kind, spans in enumerate([*near.values(), added])]
    names = F.array(*[F.lit(kind) for kind in KINDS])
    ordered = F.transform(F.array_sort(F.concat(*parts)), lambda s: F.struct(F.get(names, s["kind"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return marked.withColumn(out, ordered).drop(runs, *held.values())


def joined(found: Column, kinds: tuple[str, ...] = KINDS) -> Column:
    """kind:start:end of the spans of some kinds, comma-joined."""
    some = F.filter(found, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(some, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(df: DataFrame, text: str = "text", found: str = "found", mask: str = "<secret>") -> DataFrame:
    """The texts with every found span replaced by `mask`; overlapping spans by one."""
    held, places = fresh("held"), fresh("places")
    kind = "array<struct<start:int,end:int>>"

    def step(state: Column, s: Column) -> Column:
        apart = F.struct(s["end"].alias("at"), F.concat(state["spans"], F.array(F.struct(s["start"].alias("start"), s["end"].alias("end")))).alias("spans"))
        # What overlaps the spans so far only moves the end; the start of the next kept text follows from it.
        longer = F.struct(F.greatest(s["end"], state["at"]).alias("at"), F.concat(state["spans"], F.array(F.struct(F.lit(-1).alias("start"), F.greatest(s["end"], state["at"]).alias("end")))).alias("spans"))
        return F.when(s["start"] >= state["at"], apart).otherwise(longer)

    count = F.size(places)
    blocks = F.regexp_extract_all(F.col(text), F.lit(f"(?s)(.{{1,{BLOCK}}})"), F.lit(1))

    def piece(start: Column, end: Column) -> Column:
        """Code points from `start` to `end`, from the blocks that they lie in."""
        first = (start / BLOCK).cast("int")
        some = F.array_join(F.slice(F.col(held), first + 1, ((end - 1) / BLOCK).cast("int") - first + 1), "")
        return F.when(end > start, F.substring(some, start % BLOCK + 1, end - start)).otherwise(F.lit(""))

    def kept(i: Column) -> Column:
        start = F.when(i == 0, F.lit(0)).otherwise(F.get(places, i - 1)["end"])
        return let(F.get(places, i)["start"], lambda at: F.when(at < 0, F.lit(None)).otherwise(piece(start, at)))

    before = F.transform(F.sequence(F.lit(0), count - 1), kept)
    joined_ = F.array_join(F.transform(F.array_compact(before), lambda x: F.concat(x, F.lit(mask))), "")
    rest = piece(F.get(places, count - 1)["end"], F.col(size := fresh("size")))
    marked = df.withColumns({
        places: F.when(F.size(found) > 0, _listed(F.col(found), kind, step)),
        held: F.when(F.size(found) > 0, blocks), size: F.length(text)})
    return marked.withColumn(text, F.when(F.size(found) > 0, F.concat(joined_, rest)).otherwise(F.col(text))).drop(places, held, size)
