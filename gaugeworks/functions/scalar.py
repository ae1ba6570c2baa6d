"""Column functions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gaugeworks.functions import fixed


def clip01(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def gain_over(x: Column, base: Column) -> Column:
    """(x - base) / (1 - base) within 0 and 1; with a base of 1, 1 if x reaches it."""
    return F.when(base >= 1, F.when(x >= 1, 1.0).otherwise(0.0)).otherwise(clip01((x - base) / (1 - base)))


def magnitude_ratio(a: Column, b: Column) -> Column:
    """Smaller magnitude over larger; two zeros agree."""
    low, high = F.least(F.abs(a), F.abs(b)), F.greatest(F.abs(a), F.abs(b))
    return F.when(high <= 1e-12, 1.0).otherwise(low / high)


def shape_similarity(*pairs: tuple[Column, Column]) -> Column:
    """Geometric mean of magnitude ratios."""
    product = F.lit(1.0)
    for a, b in pairs:
        product = product * magnitude_ratio(a, b)
    return F.pow(product, F.lit(1.0 / len(pairs)))


def decade_similarity(pred: Column, true: Column) -> Column:
    """1 less the decades between the values; unobservable truth scores 1, an unreported value 0."""
    bad = (true <= 0) | (pred <= 0)
    near = F.greatest(F.lit(0.0), 1 - F.abs(F.log10(pred / true)))
    return F.when(true.isNull(), 1.0).when(pred.isNull(), 0.0).when(bad, (pred == true).cast("double")).otherwise(near)


def relative_score(pred: Column, true: Column) -> Column:
    """1 less the relative error."""
    near = F.greatest(F.lit(0.0), 1 - F.abs(pred - true) / F.abs(true))
    return F.when(true.isNull(), 1.0).when(pred.isNull(), 0.0).when(true == 0, (pred == 0).cast("double")).otherwise(near)


def betti_product(*pairs: tuple[Column, Column]) -> Column:
    out = F.lit(1.0)
    for a, b in pairs:
        out = out * F.pow((F.least(a, b) + 1) / (F.greatest(a, b) + 1), F.lit(2))
    return out


def significant(x: Column, digits: int) -> Column:
    """x rounded to significant digits as decimal text would be."""
    return F.format_string(f"%.{digits - 1}e", x).cast("double")


def lattice(x: Column, pitch: float) -> Column:
    """Nearest lattice index, halves to even."""
    return F.rint(x / pitch).cast("long")


def type_compatible(true: Column, pred: Column) -> Column:
    out = true == pred
    for kind, accepted in reversed(fixed.TYPE_COMPATIBILITY.items()):
        out = F.when(true == kind, F.lit(True) if accepted is None else pred.isin(accepted)).otherwise(out)
    return out


def rail_class(name: Column) -> Column:
    """'ground', 'supply' or null. Every segment of a rail's name is a rail name, a voltage or a bare qualifier."""
    up = F.trim(F.upper(name))
    signed = up.rlike(r"^[+-].")
    segments = F.filter(F.split(F.when(signed, F.substr(up, F.lit(2))).otherwise(up), fixed.SEGMENT_BREAK), lambda s: s != "")
    ground = lambda s: s.isin(fixed.GROUND_NAMES)
    supply = lambda s: s.isin(fixed.SUPPLY_NAMES) | s.rlike(fixed.VOLTAGE)
    known = F.forall(segments, lambda s: ground(s) | supply(s) | s.rlike(fixed.NEUTRAL))
    any_supply = F.exists(segments, lambda s: ~ground(s) & supply(s))
    any_ground = F.exists(segments, ground)
    return (
        F.when(up.isin(fixed.GROUND_NAMES), "ground")
        .when(up.isin(fixed.SUPPLY_NAMES), "supply")
        .when(~known, F.lit(None))
        .when(any_supply, "supply")
        .when(any_ground, "ground")
    )


def task_of(path: Column) -> Column:
    """The task that the first telling part of a path names: task<digits>, or t<digit>_..., else '?'."""
    parts = F.filter(F.split(path, "/"), lambda p: p.rlike(r"^task[0-9]+$") | p.rlike(r"^t[0-9]_"))
    first = F.try_element_at(parts, F.lit(1))
    return F.when(first.rlike("^task"), F.concat(F.lit("T"), F.substr(first, F.lit(5)))).when(first.isNotNull(), F.concat(F.lit("T"), F.substr(first, F.lit(2), F.lit(1)))).otherwise("?")


def case_key(path: Column) -> Column:
    """The last three parts of a path and 8 digits of the whole path's SHA-1."""
    parts = F.split(path, "/")
    return F.concat_ws("_", F.array_join(F.slice(parts, F.greatest(F.size(parts) - 2, F.lit(1)), F.lit(3)), "_"), F.substr(F.sha1(path), F.lit(1), F.lit(8)))


def tree_digest(entries: Column, separator: str = "\0") -> Column:
    """SHA-256 over path, NUL, digest, separator of an array of (path, digest) structs in path order."""
    lines = F.transform(F.array_sort(entries), lambda e: F.concat(e["path"], F.lit("\0"), e["digest"], F.lit(separator)))
    return F.sha2(F.encode(F.array_join(lines, ""), "utf-8"), 256)


def seed_of(*parts: Column) -> Column:
    """The first 4 bytes, big-endian, of the SHA-256 of the parts joined by '/'."""
    return F.conv(F.substr(F.sha2(F.encode(F.concat_ws("/", *parts), "utf-8"), 256), F.lit(1), F.lit(8)), 16, 10).cast("long")


def token_estimate(system: Column, texts: Column, images: Column) -> Column:
    """Tokens of a prompt: a quarter of the characters of each text, 4800 an image."""
    floor = lambda x: F.floor(x / 4)
    return floor(F.length(system)) + F.aggregate(texts, F.lit(0).cast("long"), lambda s, t: s + floor(F.length(t))) + 4800 * images


def duration_seconds(text: Column) -> Column:
    """Seconds of '1m3s', '250ms', '2h' or a plain number; null if none."""
    parts = F.regexp_extract_all(text, F.lit(r"([0-9]+(?:\.[0-9]+)?)(ms|s|m|h)"), F.lit(0))
    unit = lambda p: F.when(p.endswith("ms"), 0.001).when(p.endswith("s"), 1.0).when(p.endswith("m"), 60.0).otherwise(3600.0)
    total = F.aggregate(parts, F.lit(0.0), lambda s, p: s + F.regexp_extract(p, r"^[0-9.]+", 0).cast("double") * unit(p))
    return F.when(text.rlike(r"^\s*[0-9]+(\.[0-9]+)?\s*$"), F.trim(text).cast("double")).when(F.size(parts) > 0, total)


def is_secret_name(name: Column) -> Column:
    """Whether an environment variable's name says that it holds a secret."""
    return F.upper(name).rlike(r"(_KEY|_TOKEN|_PASSWORD|_CREDENTIALS)$") | F.upper(name).contains("SECRET")


def last_fence(text: Column, kind: str) -> Column:
    """The body of the last fenced block of a kind; null if there is none."""
    blocks = F.regexp_extract_all(text, F.lit(rf"(?s)```{kind}\s*\n(.*?)```"), F.lit(1))
    return F.try_element_at(blocks, F.lit(-1))


def determinant(m: list[Column]) -> Column:
    """Of a 3 x 3 matrix by rows."""
    a, b, c, d, e, f, g, h, i = m
    return a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)


def rigid_reason(m: list[Column], tolerance: float = fixed.RIGID_TOLERANCE) -> Column:
    """Why 16 numbers by rows are no rigid transform; null if they are one."""
    rotation = [m[4 * r + c] for r in range(3) for c in range(3)]
    worst = F.lit(0.0)
    for r in range(3):
        for s in range(3):
            dot = sum((rotation[3 * r + k] * rotation[3 * s + k] for k in range(1, 3)), rotation[3 * r] * rotation[3 * s])
            worst = F.greatest(worst, F.abs(dot - (1 if r == s else 0)))
    bottom = (m[12] == 0) & (m[13] == 0) & (m[14] == 0) & (m[15] == 1)
    finite = F.lit(True)
    for x in m:
        finite = finite & x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.when(~finite, "not finite").when(~bottom, "bottom row").when(worst > tolerance, "not orthonormal").when(F.abs(determinant(rotation) - 1) > tolerance, "not a rotation")


def affine(m: list[Column], x: Column, y: Column, z: Column) -> list[Column]:
    """A 4 x 4 transform (16 columns by rows) of a point."""
    return [m[4 * r] * x + m[4 * r + 1] * y + m[4 * r + 2] * z + m[4 * r + 3] for r in range(3)]


def half_even(value: Column, digits: int = 4) -> Column:
    """Rounded to digits, ties (of the value's shortest decimal form) to the even digit."""
    return F.bround(value.cast("decimal(38,18)"), digits).cast("double")


def seconds_between(start: Column, end: Column) -> Column:
    """Seconds from one ISO-8601 time to another, to one digit; null if either is missing or unreadable."""
    at = lambda c: F.try_to_timestamp(c).cast("double")
    return half_even(at(end) - at(start), 1)


def nested_count(value: Column, *paths: str) -> Column:
    """The first whole number at these paths of a variant, null if there is none; true and false are no numbers."""
    whole = lambda p: F.when(F.schema_of_variant(F.try_variant_get(value, p, "variant")).isin("BIGINT", "INT", "SMALLINT", "TINYINT"), F.try_variant_get(value, p, "bigint"))
    return F.coalesce(*[whole(p) for p in paths])


def default_classes(ctype: Column, terminals: Column, classes: Column) -> Column:
    """Classes of interchangeable terminals (arrays of places): as declared, else the two of a symmetric type as one, else each alone."""
    alone = F.transform(F.sequence(F.lit(0), terminals - 1), lambda i: F.array(i.cast("int")))
    pair = F.array(F.array(F.lit(0), F.lit(1)))
    none = F.array().cast("array<array<int>>")
    return F.when(F.size(classes) > 0, classes).when(terminals <= 0, none).when(ctype.isin(fixed.PAIRWISE_TYPES) & (terminals == 2), pair).otherwise(alone)


def nulls_as(column: Column, text: str) -> Column:
    """A sort key in which null stands as this text."""
    return F.coalesce(column.cast("string"), F.lit(text))
