"""Whitening of embeddings by the exact characteristic polynomial of their scatter.

Every entry c of a vector becomes the whole number x = floor(1024 * c) + 100000. From
then on all is exact until a component is rounded to doubles:

1. Tasks add up n, S and the products of x in whole numbers; the sums do not depend on
   how rows are dealt. The integer scatter is M = n * sum(x x') - S S' = n^2 * V.
2. The characteristic polynomial of M is worked out modulo primes below 2^31 by
   reduction to Hessenberg form, the primes dealt to tasks, and put together by the
   Chinese remainder theorem. There are as many primes as the coefficients can be large.
3. All roots are real, so the sign changes of the polynomial shifted by a are exactly
   the number of roots above a. Bisection by that count isolates each root, with its
   multiplicity, and goes on by the sign alone to a 2^-200th of the trace.
4. Inverse iteration on M less the root, in whole numbers of 256 binary places, gives
   the null space; several roots in one place give an orthonormal basis of theirs.

Rows then are projected on the unit components in doubles. What the driver holds is a
matrix of the vectors' width and as many polynomials, whatever the number of rows.

Cases: vectors that are null, or hold null or non-finite entries, take no part; nor do
those whose width is not the most frequent one (of equals the lesser), for which there
is no covariance. Entries whose floor(1024 * c) lies beyond 2^62 count as that. A
component whose eigenvalue is zero can't be scaled to one and is left out, so one
vector, or equal ones, give no rows. Repeated ids are rows of their own, a missing id
is kept, an empty table gives no rows, other columns are not returned.
"""

from collections.abc import Iterator
from decimal import Context, Decimal
from fractions import Fraction
from math import comb, isqrt, prod, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspan.llm.scratch import fresh, stored

SCALE, SHIFT = 1024, 100_000
FARTHEST = 1 << 62
COMPONENTS = 8
#: Bits of a limb and rows of a block: products of limbs, summed over a block, stay below 2^53.
LIMB, BLOCK = 20, 1 << 12
#: Bits of the parts in which sums travel.
PART = 60
#: A root is known to the trace divided by 2 ** PLACES; vectors have FRACTION binary places.
PLACES, FRACTION = 200, 256
#: Primes that a task reduces at once.
AT_ONCE = 16


# Whole-number sums -----------------------------------------------------------------
def whole_numbers(vectors: np.ndarray) -> np.ndarray:
    """floor(1024 * c), without the shift: it changes no covariance and no deviation."""
    with np.errstate(over="ignore"):
        scaled = np.floor(vectors.astype(np.float64) * SCALE)
    return np.clip(scaled, -float(FARTHEST), float(FARTHEST)).astype(np.int64)


def products(y: np.ndarray) -> np.ndarray:
    """y' y of whole numbers, exactly, as Python's own."""
    total = np.zeros((y.shape[1], y.shape[1]), dtype=object)
    for at in range(0, len(y), BLOCK):
        rest, limbs = y[at : at + BLOCK], []
        while True:
            if np.abs(rest).max(initial=0) < 1 << LIMB:
                limbs.append(rest.astype(np.float64))
                break
            limbs.append((rest & ((1 << LIMB) - 1)).astype(np.float64))
            rest = rest >> LIMB
        for i, a in enumerate(limbs):
            for j, b in enumerate(limbs):
                total += (a.T @ b).astype(np.int64).astype(object) << (LIMB * (i + j))
    return total


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, width)


def sums(rows: DataFrame, vector: str, width: int) -> np.ndarray:
    """Products of (1, y) over all rows: n, sums and products of the whole numbers."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width + 1, width + 1), dtype=object)
        for batch in batches:
            if batch.num_rows:
                y = whole_numbers(_matrix(batch.column(0), width))
                total += products(np.hstack([np.ones((len(y), 1), dtype=np.int64), y]))
        out: list[tuple] = []
        for i in range(width + 1):
            for j in range(i, width + 1):
                value, part = int(total[i, j]), 0
                while value:
                    low = value if -(1 << PART) < value < 1 << PART else value & ((1 << PART) - 1)
                    out.append((i, j, part, low))
                    value, part = (value - low) >> PART, part + 1
        yield pa.RecordBatch.from_arrays([pa.array([one[k] for one in out], pa.int64()) for k in range(4)], names=["i", "j", "part", "value"])

    parts = rows.select(vector).mapInArrow(add, "i long, j long, part long, value long")
    found = np.zeros((width + 1, width + 1), dtype=object)
    # (width + 1)^2 entries of a few parts each.
    for row in parts.groupBy("i", "j", "part").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).toLocalIterator():
        found[row.i, row.j] += int(row.value) << (PART * row.part)
        if row.i != row.j:
            found[row.j, row.i] = found[row.i, row.j]
    return found


# Characteristic polynomial ----------------------------------------------------------
def is_prime(n: int) -> bool:
    """For n below 2^32."""
    if n < 2 or any(n % p == 0 for p in (2, 3, 5, 7)):
        return n in (2, 3, 5, 7)
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 7, 61):
        power = pow(base, odd, n)
        if base % n and power not in (1, n - 1) and all((power := power * power % n) != n - 1 for _ in range(twos - 1)):
            return False
    return True


def primes_beyond(limit: int) -> list[int]:
    """Primes below 2^31, greatest first, whose product is above `limit`."""
    found, reached, at = [], 1, (1 << 31) - 1
    while reached <= limit:
        if is_prime(at):
            found.append(at)
            reached *= at
        at -= 2
    return found


def polynomial_modulo(matrix: np.ndarray, primes: list[int]) -> np.ndarray:
    """Coefficients, lowest first, of the characteristic polynomial modulo each prime."""
    width = len(matrix)
    p = np.array(primes, dtype=np.int64)
    a = np.stack([(matrix % one).astype(np.int64) for one in primes])
    for m in range(width - 2):
        for k in np.flatnonzero(a[:, m + 1, m] == 0):
            below = np.flatnonzero(a[k, m + 2 :, m])
            if len(below):
                r = m + 2 + int(below[0])
                a[k, [m + 1, r], :] = a[k, [r, m + 1], :]
                a[k, :, [m + 1, r]] = a[k, :, [r, m + 1]]
        inverse = np.array([pow(int(x), -1, q) if x else 0 for x, q in zip(a[:, m + 1, m], primes, strict=True)], dtype=np.int64)
        times = a[:, m + 2 :, m] * inverse[:, None] % p[:, None]
        a[:, m + 2 :, :] = (a[:, m + 2 :, :] - times[:, :, None] * a[:, m + 1 : m + 2, :]) % p[:, None, None]
        a[:, :, m + 1] = (a[:, :, m + 1] + (a[:, :, m + 2 :] * times[:, None, :] % p[:, None, None]).sum(axis=2)) % p[:, None]
    grown = np.zeros((len(primes), width + 1, width + 1), dtype=np.int64)
    grown[:, 0, 0] = 1
    for k in range(1, width + 1):
        weights = np.zeros((len(primes), k), dtype=np.int64)
        weights[:, k - 1], chain = a[:, k - 1, k - 1], np.ones(len(primes), dtype=np.int64)
        for i in range(k - 2, -1, -1):
            chain = chain * a[:, i + 1, i] % p
            weights[:, i] = a[:, i, k - 1] * chain % p
        grown[:, k, 1:] = grown[:, k - 1, :-1]
        grown[:, k] = (grown[:, k] - (weights[:, :, None] * grown[:, :k] % p[:, None, None]).sum(axis=1)) % p[:, None]
    return grown[:, width]


def joined(primes: list[int], residues: np.ndarray) -> list[int]:
    """The whole numbers of least size that leave the residues."""
    product = prod(primes)
    shares = [(product // q) * pow(product // q, -1, q) for q in primes]
    found = [sum(int(r) * share for r, share in zip(column, shares, strict=True)) % product for column in residues.T]
    return [one - product if 2 * one > product else one for one in found]


def characteristic(spark, matrix: np.ndarray) -> list[int]:
    """Coefficients, lowest first, of a whole-number matrix without negative eigenvalues."""
    width = len(matrix)
    trace = int(sum(matrix[i, i] for i in range(width)))
    # With a given sum, the elementary symmetric functions are greatest for equal eigenvalues.
    limit = max(comb(width, k) * trace**k // width**k + 1 for k in range(width + 1))
    primes = primes_beyond(2 * limit)
    shared = spark.sparkContext.broadcast(matrix)  # as wide as the vectors are

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = [one for batch in batches for one in batch.column(0).to_pylist()]
        for at in range(0, len(mine), AT_ONCE):
            some = mine[at : at + AT_ONCE]
            yield pa.RecordBatch.from_pydict({"prime": pa.array(some, pa.int64()), "residues": pa.array(polynomial_modulo(shared.value, some).tolist(), pa.list_(pa.int64()))})

    tasks = -(-len(primes) // AT_ONCE)
    dealt = spark.createDataFrame([(one,) for one in primes], "prime long").repartition(tasks)
    got = {row.prime: row.residues for row in dealt.mapInArrow(reduce, "prime long, residues array<long>").collect()}
    return joined(primes, np.array([got[one] for one in primes], dtype=object))


# Roots and components ---------------------------------------------------------------
def roots_above(f: list[int], a: int) -> int:
    """How many roots, all real, of the polynomial are greater than `a`."""
    g = list(f)
    for i in range(len(g) - 1):
        for j in range(len(g) - 2, i - 1, -1):
            g[j] += a * g[j + 1]
    signs = [c > 0 for c in g if c]
    return sum(one != other for one, other in zip(signs, signs[1:]))


def value_at(f: list[int], a: int) -> int:
    total = 0
    for c in reversed(f):
        total = total * a + c
    return total


def isolate(f: list[int], k: int, top: int) -> tuple[int, int, int]:
    """(a, m, j): the k-th greatest root lies in (a, a + 1], as the j-th greatest of m there."""
    low, high, above_low, above_high = -1, top, len(f) - 1, 0
    while high - low > 1:
        middle = (low + high) // 2
        if above_low - above_high == 1:  # the sign alone tells on which side the root is
            value = value_at(f, middle)
            here = above_high + ((value < 0) == (above_high % 2 == 0) and value != 0)
        else:
            here = roots_above(f, middle)
        if here >= k:
            low, above_low = middle, here
        else:
            high, above_high = middle, here
    return low, above_low - above_high, k - above_high


def _over(values: np.ndarray, divisor: int) -> np.ndarray:
    return (values << FRACTION) // divisor


def _unit(vectors: list[np.ndarray]) -> list[np.ndarray]:
    """Orthonormal vectors that span the same, in whole numbers of FRACTION places."""
    out: list[np.ndarray] = []
    for vector in vectors:
        for _ in range(2):
            for other in out:
                vector = vector - ((other * (int((vector * other).sum()) >> FRACTION)) >> FRACTION)
        out.append(_over(vector, isqrt(int((vector * vector).sum())) or 1))
    return out


def null_space(matrix: np.ndarray, root: Fraction, dimension: int) -> list[np.ndarray]:
    """Orthonormal vectors of the eigenvalues next to `root`, by inverse iteration."""
    width = len(matrix)
    trace = int(sum(matrix[i, i] for i in range(width)))
    a = (matrix << FRACTION) // trace
    for i in range(width):
        a[i, i] -= int(root / trace * (1 << FRACTION))
    order, factors = np.arange(width), np.zeros((width, width), dtype=object)
    for k in range(width):
        r = k + int(np.argmax(np.abs(a[k:, k])))
        a[[k, r]], order[[k, r]], factors[[k, r]] = a[[r, k]], order[[r, k]], factors[[r, k]]
        a[k, k] = a[k, k] or 1
        factors[k + 1 :, k] = _over(a[k + 1 :, k], a[k, k])
        a[k + 1 :, k:] -= np.outer(factors[k + 1 :, k], a[k, k:]) >> FRACTION
    draw = np.random.default_rng(42)
    found = [draw.integers(-(1 << 40), 1 << 40, width).astype(object) << (FRACTION - 40) for _ in range(dimension)]
    for _ in range(3):
        solved = []
        for vector in _unit(found):
            x = vector[order]
            for k in range(width):
                x[k + 1 :] -= (factors[k + 1 :, k] * x[k]) >> FRACTION
            for k in range(width - 1, -1, -1):
                x[k] = (x[k] << FRACTION) // a[k, k]
                x[:k] -= (a[:k, k] * x[k]) >> FRACTION
            # As large as a vector of FRACTION places again.
            extra = max(int(np.abs(x).max()).bit_length() - FRACTION, 0)
            solved.append(x >> extra)
        found = _unit(solved)
    return found


def component(matrix: np.ndarray, f: list[int], k: int) -> tuple[Fraction, list[float]]:
    """The k-th greatest eigenvalue and its unit vector, the greatest entry positive."""
    width = len(matrix)
    trace = int(sum(matrix[i, i] for i in range(width)))
    places = max(PLACES - trace.bit_length(), 0)
    scaled = [c << (places * (width - i)) for i, c in enumerate(f)]
    a, several, which = isolate(scaled, k, (trace << places) + 1)
    root = Fraction(2 * a + 1, 2 << places)
    vector = null_space(matrix, root, several)[which - 1]
    if vector[int(np.argmax(np.abs(vector)))] < 0:
        vector = -vector
    return root, [float(Fraction(int(x), 1 << FRACTION)) for x in vector]


def components(spark, matrix: np.ndarray, most: int = COMPONENTS) -> list[tuple[int, Fraction, list[float]]]:
    """(number, eigenvalue, unit vector) of the greatest eigenvalues that are not zero."""
    f = characteristic(spark, matrix)
    zeros = next(i for i, c in enumerate(f) if c)
    count = min(most, len(matrix) - zeros)
    shared = spark.sparkContext.broadcast((matrix, f))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = [int(k) for k in batch.column(0).to_pylist()]
            solved = [component(*shared.value, k) for k in numbers]
            yield pa.RecordBatch.from_pydict({
                "k": pa.array(numbers, pa.int64()),
                "root": pa.array([f"{root.numerator}/{root.denominator}" for root, _ in solved], pa.string()),
                "vector": pa.array([vector for _, vector in solved], pa.list_(pa.float64())),
            })

    if not count:
        return []
    numbers = spark.createDataFrame([(k + 1,) for k in range(count)], "k long").repartition(count)
    return sorted((row.k, Fraction(row.root), row.vector) for row in numbers.mapInArrow(solve, "k long, root string, vector array<double>").collect())


# Rows -------------------------------------------------------------------------------
def deviations(y: np.ndarray, n: int, total: list[int]) -> list[Decimal | None]:
    """Sum over dimensions of (n x - S)^2, exactly; null beyond 38 digits."""
    context = Context(prec=60)
    if n * int(np.abs(y).max(initial=0)) + max(map(abs, total), default=0) < isqrt((1 << 63) // max(y.shape[1], 1)):
        apart = y * n - np.array(total, dtype=np.int64)
        exact = (apart * apart).sum(axis=1).tolist()
    else:
        apart = y.astype(object) * n - np.array(total, dtype=object)
        exact = (apart * apart).sum(axis=1).tolist()
    return [context.create_decimal(one) if one < 10**38 else None for one in exact]


def whiten(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation (decimal), whitened, explained, identity_error."""
    spark, held, wide = df.sparkSession, fresh("held"), fresh("wide")
    finite = "forall({0}, c -> c is not null and not isnan(c) and abs(c) <> double('infinity'))".format(held)
    rows = df.select(F.col(vec_id).alias("vec_id"), F.col(vector).cast("array<double>").alias(held)).where(F.col(held).isNotNull() & F.expr(finite))
    empty = f"vec_id {df.schema[vec_id].dataType.simpleString()}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    widths = rows.groupBy(F.size(held).alias("width")).count().orderBy(F.desc("count"), "width").first()
    if widths is None or not widths.width:
        return spark.createDataFrame([], empty)
    width = widths.width
    rows = rows.where(F.size(held) == width)
    every = sums(rows, held, width)
    n, total = int(every[0, 0]), [int(x) for x in every[0, 1:]]
    matrix = every[1:, 1:] * n - np.outer(every[0, 1:], every[0, 1:])
    trace = sum(int(matrix[i, i]) for i in range(width))
    found = components(spark, matrix, most) if trace else []
    if not found:
        return spark.createDataFrame([], empty)
    mean = np.array([float(Fraction(one, n)) for one in total])
    turn = np.array([np.array(v) / sqrt(Fraction(root, n * n)) for _, root, v in found]).T

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = whole_numbers(_matrix(batch.column(1), width))
            whitened = (y - mean) @ turn
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1, dtype=np.int32) * turn.shape[1]), pa.array(whitened.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(deviations(y, n, total), pa.decimal128(38, 0)), lists], names=["vec_id", "deviation", wide])

    schema = f"vec_id {df.schema[vec_id].dataType.simpleString()}, deviation decimal(38,0), {wide} array<double>"
    done = stored(rows.select("vec_id", held).mapInArrow(project, schema), "whitened")
    error = identity_error(done, wide, len(found))
    explained = F.array(*[F.lit(float(Fraction(root, trace))) for _, root, _ in found])
    return done.select("vec_id", "deviation", F.posexplode(wide).alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"),
    )


def identity_error(done: DataFrame, wide: str, count: int) -> float:
    """Largest absolute entry of the whitened rows' covariance less the identity."""
    averages = done.agg(*[F.avg(F.get(wide, F.lit(k))).alias(f"m{k}") for k in range(count)]).first()
    mean = np.array(list(averages))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros((count, count)), 0
        for batch in batches:
            apart = _matrix(batch.column(0), count) - mean
            total, rows = total + apart.T @ apart, rows + len(apart)
        yield pa.RecordBatch.from_pydict({"n": pa.array([rows], pa.int64()), "products": pa.array([total.ravel().tolist()], pa.list_(pa.float64()))})

    parts = done.select(wide).mapInArrow(spread, "n long, products array<double>")
    added = parts.agg(F.sum("n").alias("n"), *[F.sum(F.get("products", F.lit(k))).alias(f"p{k}") for k in range(count * count)]).first()
    covariance = np.array(list(added)[1:]).reshape(count, count) / added.n
    return float(np.abs(covariance - np.eye(count)).max())
