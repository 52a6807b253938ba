"""Distances of meanings: word sets, vectors, blends, and pasted answers of a model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glossa.functions.text import js_trim, let, semantic_tokens

RULE_WEIGHT, EMBEDDING_WEIGHT = 0.7, 0.3

# The prompt's lines before, between and after the two meanings.
PROMPT = (
    "You are a linguistic assistant. Estimate semantic distance between two meaning formulations.",
    "",
    "Task context:",
    "- Determine value type in Determinator of valen typ.",
    "- The app computes final score as Rule-based + embedding estimate.",
    "- Your part: provide embedding-like meaning similarity from 0 to 1.",
    "",
    'Logical analysis: "{logical}"',
    'International meaning: "{international}"',
    "",
    "Response requirements:",
    "1) Respond with exactly one JSON object without Markdown.",
    "2) Format:",
    '{"distance":0.00,"similarity":0.00,"reason":"краткое пояснение"}',
    "3) distance = 0 means almost same meaning, distance = 1 means very far.",
    "4) similarity = 1 - distance.",
    "5) Use decimal numbers with precision to two digits.",
    "",
    "Return JSON only.",
)
_NUMBER = r"""["'\s:=]+(-?\d+(?:\.\d+)?)"""


def clamp01(x: Column) -> Column:
    """Into [0, 1]; 0 if not finite."""
    odd = F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(odd | x.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def clamp(x: Column, low: float, high: float) -> Column:
    """Into [low, high]; NaN and null stay."""
    return F.when(F.isnan(x) | x.isNull(), x).otherwise(F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def weighted_move(x: Column, target: float, amount: float) -> Column:
    """The share `amount` of the way from x to target; 0 if x isn't finite."""
    odd = F.isnan(x) | (F.abs(x) == float("inf")) | x.isNull()
    return F.when(odd, 0.0).otherwise(x * (1 - amount) + target * amount)


def almost_equal(a: Column, b: Column, eps: float = 1e-10) -> Column:
    return F.abs(a - b) <= eps


def jaccard(a: Column, b: Column) -> Column:
    """struct(similarity, distance, intersection, union) of two texts' word sets; two blanks: union 1, similarity 0."""

    def of_sets(sets: Column) -> Column:
        both = F.size(F.array_intersect(sets["x"], sets["y"])).cast("long")
        union = F.greatest(F.size(F.array_union(sets["x"], sets["y"])).cast("long"), F.lit(1).cast("long"))
        similarity = both / union
        return F.struct(similarity.alias("similarity"), (1 - similarity).alias("distance"), both.alias("intersection"), union.alias("union"))

    return let(F.struct(F.array_distinct(semantic_tokens(a)).alias("x"), F.array_distinct(semantic_tokens(b)).alias("y")), of_sets)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; 0 if either is a zero vector, null if the lengths differ or either is null."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(F.size(a) == F.size(b), F.when(norms == 0, 0.0).otherwise(dot(a, b) / F.when(norms != 0, norms)))


def embedding_distance(a: Column, b: Column) -> Column:
    """struct(similarity_raw, similarity, distance): the cosine moved from [-1, 1] to [0, 1]."""

    def moved(raw: Column) -> Column:
        similarity = clamp((raw + 1) / 2, 0.0, 1.0)
        return F.when(raw.isNotNull(), F.struct(raw.alias("similarity_raw"), similarity.alias("similarity"), clamp(1 - similarity, 0.0, 1.0).alias("distance")))

    return let(cosine(a, b), moved)


def combined(rule_distance: Column, other_distance: Column, rule_weight: float = RULE_WEIGHT, other_weight: float = EMBEDDING_WEIGHT) -> Column:
    """struct(distance, similarity, rule_weight, embedding_weight): a weighted blend, or the rule alone if the other is null."""
    rw, ew = rule_weight / (rule_weight + other_weight), other_weight / (rule_weight + other_weight)

    def blended(d: Column) -> Column:
        alone = d["other"].isNull()
        distance = F.when(alone, d["rule"]).otherwise(clamp(rw * d["rule"] + ew * d["other"], 0.0, 1.0))
        weight = lambda both, rule: F.when(alone, rule).otherwise(both)
        return F.struct(distance.alias("distance"), (1 - distance).alias("similarity"), weight(rw, 1.0).alias("rule_weight"), weight(ew, 0.0).alias("embedding_weight"))

    return let(F.struct(rule_distance.alias("rule"), other_distance.alias("other")), blended)


def _found(text: Column, *patterns: str) -> Column:
    """The first number after a word, by the first pattern that matches."""
    return F.coalesce(*[F.nullif(F.regexp_extract(text, f"(?iu){p}{_NUMBER}", 1), F.lit("")).cast("double") for p in patterns])


def parse_manual_response(raw: Column) -> Column:
    """struct(similarity, distance, reason, error) of a pasted answer; null if it is blank.

    Numbers of a JSON object come first, then numbers after the words, then the first
    number anywhere as the distance. Values over 1 up to 100 are per cent; the missing one
    is the other's complement. Without any number error is true and the rest null.
    """

    def read(t: Column) -> Column:
        # JSON only if the text is one whole object: what stands after it makes it no JSON.
        whole = F.when(t.startswith("{") & t.endswith("}"), F.try_parse_json(t))
        return F.struct(t.alias("text"), *[F.try_variant_get(whole, f"$.{n}", "variant").alias(n) for n in ("similarity", "distance", "reason")])

    def number(v: Column) -> Column:
        return F.when(F.schema_of_variant(v).rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT)"), F.try_variant_get(v, "$", "double"))

    def numbers(r: Column) -> Column:
        similarity = F.coalesce(number(r["similarity"]), _found(r["text"], "similarity", "схожесть"))
        distance = F.coalesce(number(r["distance"]), _found(r["text"], "distance", "дистанц(?:ия|ию|ии)"))
        first = F.nullif(F.regexp_extract(r["text"], r"-?\d+(?:\.\d+)?", 0), F.lit("")).cast("double")
        reason = F.when(F.schema_of_variant(r["reason"]) == "STRING", F.try_variant_get(r["reason"], "$", "string"))
        return F.struct(similarity.alias("s"), distance.alias("d"), first.alias("first"), F.coalesce(reason, F.lit("")).alias("reason"))

    def scaled(n: Column) -> Column:
        part = lambda x: F.when((x > 1) & (x <= 100), x / 100).otherwise(x)
        return F.struct(part(n["s"]).alias("s"), part(F.when(n["s"].isNull() & n["d"].isNull(), n["first"]).otherwise(n["d"])).alias("d"), n["reason"].alias("reason"))

    def whole(n: Column) -> Column:
        s, d = F.coalesce(n["s"], 1 - n["d"]), F.coalesce(n["d"], 1 - n["s"])
        return F.struct(clamp(s, 0.0, 1.0).alias("similarity"), clamp(d, 0.0, 1.0).alias("distance"), F.when(s.isNotNull(), n["reason"]).alias("reason"), s.isNull().alias("error"))

    text = js_trim(F.coalesce(raw, F.lit("")))
    return let(text, lambda t: F.when(t != "", let(let(let(read(t), numbers), scaled), whole)))


def manual_prompt(logical: Column, international: Column) -> Column:
    """The prompt for a model's answer; a blank meaning shows as a dash."""
    lines = []
    for line in PROMPT:
        for name, meaning in (("{logical}", logical), ("{international}", international)):
            if name in line:
                before, after = line.split(name)
                lines.append(F.concat(F.lit(before), F.coalesce(F.nullif(meaning, F.lit("")), F.lit("—")), F.lit(after)))
                break
        else:
            lines.append(F.lit(line))
    return F.concat_ws("\n", *lines)
