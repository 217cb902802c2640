"""Quality classification with hierarchical empirical Bayes over sites.

A document's own evidence is a naive Bayes log-likelihood ratio of binned shares
(capitals, symbols, digits, exclamation marks, repeated words, words by characters) and of its
length, learnt from labelled rows. Sites add a prior: the expected share of good
documents of a path (source and language) is shrunk toward that of its host (source),
and the host's toward the global one. How strongly is learnt from the data: of the
spread of the sites' shares, what sampling alone would give is taken off, and the rest
is how much sites truly differ (method of moments), so a sparse site says little.
A document's posterior adds its evidence to the log odds of its path.

Counts run over all documents: each counts with its label or else with its expected
label. A site is one row after partial sums, however many documents it has.

Cases: a null text is as an empty one; missing host or path values are a site of their
own; contradicting labels of one id count by their mean; repeated rows are judged
alike; without labels of both kinds the evidence is 0 and the prior one half; an empty
table gives no rows; columns named like the results are replaced.
"""

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspan.llm.scratch import let, stored

#: Labelled rows that the evidence is learnt from, about: those of the lowest hashed ids.
SAMPLE = 50_000
#: Bin edges of the shares, and of the length in words (as powers of four).
EDGES = (0.0, 0.002, 0.005, 0.01, 0.02, 0.04, 0.08, 0.16, 0.32, 0.64)
#: Characters added to a text's length, so that a few capitals say little of a short text.
SHORT = 100
SYMBOLS = "#$%&*+<=>@\\^_`{|}~[]/"
FEATURES = ("upper", "symbols", "digits", "shouts", "repeats", "density", "words")
#: More bins than any feature has.
BINS = 40
#: No site is trusted as if it had fewer or more than so many documents of its own.
WEAKEST, STRONGEST = 2.0, 10_000.0
ROUND = 6


def features(text: Column) -> Column:
    """Array of bin numbers, in the order of FEATURES."""
    whole = F.coalesce(text, F.lit(""))
    size = F.length(whole)
    return let(F.split(whole, r"[\x20\x09-\x0D]+"), lambda words: _bins(whole, size, words))


def _bins(whole: Column, size: Column, words: Column) -> Column:
    count = F.size(words)

    def share(some: str) -> Column:
        return F.regexp_count(whole, F.lit(some)) / (size + SHORT)

    repeats = F.size(F.filter(words, lambda w, i: (w != "") & (w == F.get(words, i - 1)))) / (count + SHORT / 10)
    symbols = "[" + "".join(f"\\{c}" for c in SYMBOLS) + "]"
    shares = F.array(share("[A-Z]"), share(symbols), share("[0-9]"), share("[!?]"), repeats, count / (size + SHORT))
    edges = F.array(*[F.lit(edge) for edge in EDGES])
    binned = F.transform(shares, lambda s: F.size(F.filter(edges, lambda edge: s > edge)))
    return F.concat(binned, F.array(F.floor(F.log2(count.cast("double")) / 2).cast("int")))


def learn(marked: DataFrame, labels: DataFrame, doc_id: str, label: str, size: int = SAMPLE) -> dict[tuple[int, int], float]:
    """Log-likelihood ratio (good over bad) of each feature's bins, from labelled rows."""
    total = labels.count()
    spot = F.pmod(F.xxhash64(F.col(doc_id).cast("string")), F.lit(1 << 20))
    some = labels if total <= size else labels.where(spot < size * (1 << 20) // total)
    pairs = marked.join(some.select(doc_id, label), doc_id).select(F.col(label).alias("good"), F.posexplode("bins").alias("feature", "bin"))
    rows = pairs.groupBy("feature", "bin").agg(F.sum("good").alias("good"), F.sum(1 - F.col("good")).alias("bad")).collect()
    out = {}
    for feature in {row.feature for row in rows}:
        own = [row for row in rows if row.feature == feature]
        good, bad = sum(row.good for row in own), sum(row.bad for row in own)
        if good and bad:
            for row in own:
                out[feature, row.bin] = round(math.log((row.good + 0.5) / (good + 0.5 * len(own))) - math.log((row.bad + 0.5) / (bad + 0.5 * len(own))), ROUND)
    return out


def _evidence(bins: Column, model: dict[tuple[int, int], float]) -> Column:
    table = [[model.get((feature, which), 0.0) for which in range(BINS)] for feature in range(len(FEATURES))]
    weights = F.split(F.lit(",".join(str(one) for row in table for one in row)), ",").cast("array<double>")
    return let(bins, lambda own: sum((F.get(weights, F.lit(k * BINS) + F.get(own, F.lit(k))) for k in range(len(FEATURES))), F.lit(0.0)))


def _strength(sites: DataFrame, prior: Column) -> float:
    """How many documents the prior is worth, from how much sites differ beyond chance."""
    row = sites.where("n > 1").select((F.col("good") / F.col("n")).alias("p"), "n", prior.alias("m")).agg(
        F.sum(F.col("n") * (F.col("p") - F.col("m")) ** 2).alias("spread"), F.sum(F.col("m") * (1 - F.col("m"))).alias("chance"),
        F.sum(F.col("n") * F.col("m") * (1 - F.col("m"))).alias("weight"), F.sum("n").alias("n"), F.count("*").alias("sites")
    ).first()
    if not row.sites or not row.weight:
        return STRONGEST
    # spread = chance + (share of variance that is the sites' own) * (weight - chance)
    own = (row.spread - row.chance) / max(row.weight - row.chance, 1e-9)
    return STRONGEST if own <= 0 else min(STRONGEST, max(WEAKEST, 1 / own - 1))


@dataclass
class Model:
    """Evidence of each feature's bins (40 at most), and a stored table of the sites' priors."""

    weights: dict[tuple[int, int], float]
    priors: DataFrame
    middle: float


def _sites(host: str, path: str) -> list[Column]:
    return [F.coalesce(F.col(one).cast("string"), F.lit("")).alias(name) for one, name in ((host, "host"), (path, "path"))]


def fit(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", path: str = "lang", label: str = "quality") -> Model:
    """Learn evidence and priors; `labels` has doc_id and a label of 1 (good) or 0."""
    known = stored(
        labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(doc_id).alias("doc_id")).agg(F.avg(F.col(label).cast("double")).alias("label")),
        "labels",
    )
    marked = stored(df.select(F.col(doc_id).alias("doc_id"), *_sites(host, path), features(F.col(text)).alias("bins")), "features")
    weights = learn(marked, known, "doc_id", "label")
    total = known.agg(F.sum("label").alias("good"), F.count("*").alias("n")).first()
    base = ((total.good or 0.0) + 0.5) / (total.n + 1.0) if total.n else 0.5
    odds = F.lit(base / (1 - base)) * F.exp(_evidence(F.col("bins"), weights))
    # Expected labels are summed as whole millionths, so that the order of the sum says nothing.
    millionths = F.round(F.coalesce("label", odds / (1 + odds)) * 1e6).cast("long")
    paths = stored(marked.join(known, "doc_id", "left").groupBy("host", "path").agg(F.count("*").alias("n"), (F.sum(millionths) / 1e6).alias("good")), "paths")
    whole = paths.agg(F.sum("good").alias("good"), F.sum("n").alias("n")).first()
    middle = min(max((whole.good or 0) / whole.n, 1e-6), 1 - 1e-6) if whole.n else base
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    a = _strength(hosts, F.lit(middle))
    within = paths.join(hosts.select("host", ((F.col("good") + a * middle) / (F.col("n") + a)).alias("host_prior")), "host")
    b = _strength(within, F.col("host_prior"))
    priors = within.select("host", "path", F.round("host_prior", ROUND).alias("host_prior"), F.round((F.col("good") + b * F.col("host_prior")) / (F.col("n") + b), ROUND).alias("path_prior"))
    return Model(weights, stored(priors, "priors"), middle)


def score(df: DataFrame, model: Model, text: str = "text", host: str = "source", path: str = "lang") -> DataFrame:
    """Add evidence, host_prior, path_prior and quality_score (0 to 1) to each row.

    A site that the model has not seen has the global prior. The priors' table has a row
    for each site; the join broadcasts it only if it is small.
    """
    added = ["evidence", "host_prior", "path_prior", "quality_score"]
    known = model.priors.select(F.col("host").alias("_host_"), F.col("path").alias("_path_"), "host_prior", "path_prior")
    own_host, own_path = _sites(host, path)
    rows = df.drop(*added).withColumns({"_host": own_host, "_path": own_path, "evidence": F.round(_evidence(features(F.col(text)), model.weights), ROUND)})
    joined = rows.join(known, (F.col("_host") == F.col("_host_")) & (F.col("_path") == F.col("_path_")), "left")
    either = {name: F.coalesce(name, F.lit(round(model.middle, ROUND))) for name in ("host_prior", "path_prior")}
    prior = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col("path_prior")))
    whole = joined.withColumns(either).withColumn("quality_score", F.round(1 / (1 + F.exp(-(F.col("evidence") + F.ln(prior / (1 - prior))))), ROUND))
    return whole.drop("_host", "_path", "_host_", "_path_")
