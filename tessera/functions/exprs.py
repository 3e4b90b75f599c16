"""Scalar building blocks as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clamp01(x) -> Column:
    """0 to 1; null stays, NaN becomes 0."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.nanvl(_c(x), F.lit(0.0))))


def saturating(x, scale: float) -> Column:
    return 1 - F.exp(-F.greatest(_c(x), F.lit(0.0)) / F.lit(max(scale, 1e-12)))


def triangular(x, left: float, center: float, right: float) -> Column:
    """1 at center, 0 at or beyond left and right, linear between."""
    x = _c(x)
    return F.when((x <= left) | (x >= right), 0.0).when(x <= center, (x - left) / (center - left)).otherwise((right - x) / (right - center))


def project(region, background, support, how: str = "exp2") -> Column:
    """Local score from the mean rank in a region against the background, damped by the share that expresses."""
    raw = F.log2(_c(region) / _c(background)) * F.greatest(F.lit(0.0), F.least(F.lit(1.0), _c(support)))
    return F.pow(F.lit(2.0), F.greatest(raw, F.lit(0.0))) - 1 if how == "exp2" else F.log1p(F.exp(raw))


def rational(x, half: float = 0.25) -> Column:
    return _c(x) / (_c(x) + half)


def gaussian_weight(distance, sigma) -> Column:
    return F.exp(-0.5 * F.pow(_c(distance) / _c(sigma), F.lit(2)))


def cosine_weight(distance) -> Column:
    """A cosine distance as a weight of 0 to 1."""
    return clamp01((2 - _c(distance)) / 2)


def unordered_key(a, b, mark: str = "|") -> Column:
    return F.concat_ws(mark, F.least(_c(a), _c(b)), F.greatest(_c(a), _c(b)))


def stable_key(*parts: Column, spots: Column) -> Column:
    """16 hexadecimal digits from names and the sorted members."""
    return F.substring(F.sha1(F.concat_ws("|", *parts, F.array_join(F.array_sort(spots), "|"))), 1, 16)


def jaccard(a, b, empty: float = 1.0) -> Column:
    """Of two arrays as sets; empty is the value for two empty sets, one empty set gives 0."""
    a, b = _c(a), _c(b)
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(empty)).otherwise(F.size(F.array_intersect(a, b)) / union)


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, v: s + v)


def norm(a) -> Column:
    return F.sqrt(F.aggregate(F.transform(_c(a), lambda x: x.cast("double") * x), F.lit(0.0), lambda s, v: s + v))


def cosine(a, b) -> Column:
    """Cosine of two arrays; 0 when one of them has no length."""
    length = norm(a) * norm(b)
    return F.when(length > 0, dot(a, b) / length).otherwise(0.0)


def cosine_distance(a, b) -> Column:
    """0 for two zero vectors, 1 for one."""
    x, y = norm(a), norm(b)
    return F.when((x == 0) & (y == 0), 0.0).when((x == 0) | (y == 0), 1.0).otherwise(1 - dot(a, b) / (x * y))


def l1_similarity(a, b) -> Column:
    a, b = _c(a), _c(b)
    total = F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y)), F.lit(0.0), lambda s, v: s + v)
    return F.when(F.size(a) == 0, 0.0).otherwise(clamp01(1 - total / F.size(a)))


def text_token(x) -> Column:
    """Lower case, letters, digits and single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(_c(x)), r"[^a-z0-9\s]", " "), r"\s+", " "))


def term_name(x) -> Column:
    """Without a source prefix, with spaces for marks, words in title case."""
    bare = F.regexp_replace(_c(x), r"^(GOBP|GOCC|GOMF|KEGG|REACTOME|HALLMARK)_", "")
    return F.initcap(F.trim(F.regexp_replace(F.regexp_replace(bare, r"[_/]", " "), r"\s+", " ")))


def keyword_score(text, keywords: list[str], saturation: int = 3) -> Column:
    """Share of a saturating number of distinct keywords found as parts of the text."""
    found = F.size(F.filter(F.array(*[F.lit(k) for k in dict.fromkeys(keywords)]), lambda k: F.contains(_c(text), k)))
    return F.least(F.lit(1.0), found / float(saturation))


def marker_rank_score(genes, markers: list[str], limit: int) -> Column:
    """Markers weigh more the earlier they stand among the first limit genes."""
    hits = F.transform(F.array(*[F.lit(m) for m in markers]), lambda m: F.array_position(F.slice(_c(genes), 1, limit), m))
    total = F.aggregate(F.filter(hits, lambda p: p > 0), F.lit(0.0), lambda s, p: s + (limit - p + 1) / F.lit(float(limit)))
    return total / float(max(1, min(len(markers), limit)))


def strip(values, order: list[str]) -> Column:
    """axis=0.123;... in a fixed order; the three digits are what readers get back."""
    return F.array_join(F.array(*[F.concat(F.lit(a + "="), F.format_string("%.3f", F.coalesce(_c(values)[a], F.lit(0.0)))) for a in order]), ";")


def parse_strip(text) -> Column:
    return F.transform_values(F.str_to_map(_c(text), F.lit(";"), F.lit("=")), lambda k, v: v.try_cast("double"))


def number_or(x, default: float) -> Column:
    """A finite number, else the default."""
    v = _c(x).try_cast("double")
    return F.when(v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))), F.lit(default)).otherwise(v)


def truth_loose(x) -> Column:
    """Anything but a known no is yes."""
    text = F.lower(F.trim(_c(x).cast("string")))
    return F.when(text.isNull(), False).otherwise(~text.isin("", "0", "false", "f", "no", "n", "none", "nan"))


def truth_strict(x) -> Column:
    """Only a known yes is yes."""
    return F.coalesce(F.lower(F.trim(_c(x).cast("string"))).isin("1", "true", "t", "yes", "y"), F.lit(False))


def reasons(**rules: Column) -> Column:
    """Sorted names of the rules that hold, as an array."""
    return F.array_sort(F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()])))


def ladder(x, *steps: tuple[float, str], otherwise: str) -> Column:
    """The label of the first bound that x reaches."""
    out = None
    for bound, label in steps:
        out = F.when(_c(x) >= bound, label) if out is None else out.when(_c(x) >= bound, label)
    return out.otherwise(otherwise)


def saturated(value, median, mean) -> Column:
    """v / (v + c) with c the row's median, its mean where that is not positive, and 1e-8 at least."""
    c = F.greatest(F.lit(1e-8), F.when(_c(median) > 0, _c(median)).otherwise(_c(mean)))
    return _c(value) / (_c(value) + c)


# Symbols that say little, and the prefixes of haemoglobin genes.
LOW_INFORMATION = r"^(AC|AL|AP|LINC|LOC|RP[0-9]|CTD|DEPRECATED_|MIR|SNORD|SNORA|RNU|C\d+orf\d+|[A-Z]\d{5,}(?:\.\d+)?)"
HAEMOGLOBIN = ("HBA", "HBB", "HBD", "HBG", "HBM", "HBQ")


def symbol_quality(genes) -> Column:
    """(score, odd20, odd5, haemoglobin10) of an array of gene symbols in rank order; empty names don't count."""
    named = F.filter(_c(genes), lambda g: g != "")

    def share(n: int, rule) -> Column:
        first = F.slice(named, 1, n)
        return F.size(F.filter(first, rule)) / F.greatest(F.lit(1), F.size(first))

    odd20, odd5 = share(20, lambda g: g.rlike(LOW_INFORMATION)), share(5, lambda g: g.rlike(LOW_INFORMATION))
    blood = share(10, lambda g: g.rlike("^(" + "|".join(HAEMOGLOBIN) + ")"))
    return F.struct(clamp01(1 - 0.75 * odd20 - odd5 - 0.5 * blood).alias("score"), odd20.alias("odd20"), odd5.alias("odd5"), blood.alias("haemoglobin10"))


def phrase(items) -> Column:
    """a, b and c: an array of texts as a phrase, blank ones left out."""
    some = F.filter(F.transform(_c(items), lambda x: F.trim(x)), lambda x: x != "")
    n = F.size(some)
    many = F.concat(F.array_join(F.slice(some, 1, F.greatest(F.lit(1), n - 1)), ", "), F.lit(" and "), F.element_at(some, -1))
    return F.when(n == 0, "").when(n == 1, F.get(some, F.lit(0))).otherwise(many)


def state_text(label, leading, supported, state) -> Column:
    """A sentence on a state of support: focused, co_supported, mixed, or weak for all others."""
    named = F.coalesce(F.nullif(F.concat(F.upper(F.substring(F.trim(_c(label)), 1, 1)), F.lower(F.expr("substring(trim({0}), 2)".format(label)))), F.lit("")), F.lit("State"))
    lead, axes = _c(leading), _c(supported)
    # fixed values: the sentences are output texts
    ticked = F.array_join(F.transform(axes, lambda a: F.concat(F.lit("`"), a, F.lit("`"))), ", ")
    focused = F.when(lead.isNotNull(), F.concat(F.lit(" support is concentrated around `"), lead, F.lit("`, with limited co-support elsewhere."))).otherwise(" support is concentrated without a clearly named leading axis.")
    two = F.concat(F.lit(" support is co-supported by `"), F.get(axes, F.lit(0)), F.lit("` and `"), F.get(axes, F.lit(1)), F.lit("`, rather than concentrated on a single axis."))
    weak = F.lit(" support remains broad but weak, without a strongly consolidated axis.")
    shared = F.when(F.size(axes) >= 2, two).when(lead.isNotNull(), F.concat(F.lit(" support is co-supported around `"), lead, F.lit("` and another aligned axis."))).otherwise(weak)
    mixed = F.when(F.size(axes) > 0, F.concat(F.lit(" support is distributed across multiple supported axes ("), ticked, F.lit("), indicating a mixed state."))).otherwise(" support is distributed across multiple axes, indicating a mixed state.")
    rest = F.when(_c(state) == "focused", focused).when(_c(state) == "co_supported", shared).when(_c(state) == "mixed", mixed).otherwise(weak)
    return F.concat(named, rest)


def reliability_class(support, representatives, top_share) -> Column:
    """high, medium or low: how far an axis's burden rests on several representative programs."""
    s, n, t = _c(support), _c(representatives), _c(top_share)
    return F.when((s >= 0.45) & (n >= 3) & (t <= 0.60), "high").when((s >= 0.25) & (n >= 1) & (t <= 0.80), "medium").otherwise("low")
