"""The lexicon's components and the component lists of analysed words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.functions.text import js_trim
from glossa.sources import lexicon

COMPONENT = "struct<id:string,type:string,label:string,form:string,meaning:string,assimilation:string,source_id:string,category:string,base_form:string,assimilation_note:string>"
FIELDS = ("id", "type", "label", "form", "meaning", "assimilation", "source_id", "category", "base_form", "assimilation_note")


def _component(**given: Column) -> Column:
    return F.struct(*[given.get(f, F.lit(None)).cast("string").alias(f) for f in FIELDS])


def by_category(spark: SparkSession) -> DataFrame:
    """category, ordinal (its first component's place), items (in their order): the components by category."""
    items = F.array_sort(F.collect_list(F.struct("ordinal", "id", "form", "meaning", "meaning_en")))
    return lexicon.components(spark).groupBy("category").agg(F.min("ordinal").alias("ordinal"), items.alias("items"))


def localized_components(components: DataFrame, lang: str = "ru") -> DataFrame:
    """components (the fields of COMPONENT) with shown_label, shown_meaning, shown_assimilation, shown_note in a language.

    A component's source is the lexicon's by source_id, else by its own id; what the
    lexicon lacks in English is shown as it is.
    """
    spark, en = components.sparkSession, lang == "en"
    own = [c for c in components.columns]
    parts = F.broadcast(lexicon.components(spark).select("id", "category", "meaning", "meaning_en"))
    named = lambda side: parts.select(*[F.col(c).alias(f"_{side}_{c}") for c in parts.columns])
    a, b = named("a"), named("b")
    found = components.join(a, components["source_id"] == a["_a_id"], "left").join(b, components["id"] == b["_b_id"], "left")
    source = {c: F.coalesce(F.col(f"_a_{c}"), F.col(f"_b_{c}")) if c == "id" else F.when(F.col("_a_id").isNotNull(), F.col(f"_a_{c}")).otherwise(F.col(f"_b_{c}")) for c in ("id", "category", "meaning", "meaning_en")}
    found = found.withColumns({f"_s_{c}": v for c, v in source.items()})
    names = F.broadcast(lexicon.categories(spark).select(F.col("category").alias("_category"), "category_en"))
    text = lambda c: F.nullif(c, F.lit(""))
    found = found.withColumn("_label", F.coalesce(text(F.col("_s_category")), text(F.col("category")), text(F.col("label")), F.lit("")))
    found = found.join(names, found["_label"] == names["_category"], "left")
    rules = F.broadcast(lexicon.assimilations(spark).select(F.col("value").alias("_value"), F.col("label").alias("_rule"), "label_en", "root_meaning_en"))
    found = found.join(rules, found["assimilation"] == rules["_value"], "left")
    notes = F.broadcast(lexicon.prefix_variants(spark).select(F.col("note").alias("_note"), "note_en").distinct())
    found = found.join(notes, found["assimilation_note"] == notes["_note"], "left")
    root = F.col("type") == "root"
    meaning = F.when(F.col("_s_id").isNotNull(), F.coalesce("_s_meaning_en", "_s_meaning") if en else F.col("_s_meaning")).otherwise(F.col("meaning"))
    root_meaning = F.coalesce(F.col("root_meaning_en"), F.col("meaning"), F.lit("")) if en else F.coalesce("meaning", F.lit(""))
    return found.select(
        *own,
        F.when(root, "Primary root word" if en else "Основной корень").otherwise(F.coalesce("category_en", "_label") if en else F.col("_label")).alias("shown_label"),
        F.when(root, root_meaning).otherwise(meaning).alias("shown_meaning"),
        F.coalesce(F.col("label_en") if en else F.col("_rule"), F.lit("")).alias("shown_assimilation"),
        F.coalesce(F.col("note_en") if en else F.col("assimilation_note"), F.col("assimilation_note"), F.lit("")).alias("shown_note"),
    )


def root_components(choices: DataFrame) -> DataFrame:
    """choices (form, meaning, assimilation) with component: null where the form or the meaning is blank.

    A fixed assimilation gives the meaning of its root itself.
    """
    rules = F.broadcast(lexicon.assimilations(choices.sparkSession).select(F.col("value").alias("_v"), "fixed", "root_meaning"))
    found = choices.join(rules, choices["assimilation"] == rules["_v"], "left")
    form = js_trim(F.coalesce("form", F.lit("")))
    meaning = F.when(F.col("fixed"), F.coalesce("root_meaning", F.lit(""))).otherwise(js_trim(F.coalesce("meaning", F.lit(""))))
    made = _component(id=F.expr("uuid()"), type=F.lit("root"), label=F.lit("root"), form=form, meaning=meaning, assimilation=F.col("assimilation"))
    return found.withColumn("component", F.when((form != "") & (meaning != ""), made)).drop("_v", "fixed", "root_meaning")


def affix_components(choices: DataFrame) -> DataFrame:
    """choices (component_id, variant) with component: null for unknown ids, and for prefixes with variants unless
    variant names one of their forms."""
    spark = choices.sparkSession
    parts = F.broadcast(lexicon.components(spark).select(F.col("id").alias("_id"), F.col("category").alias("_category"), F.col("form").alias("_form"), F.col("meaning").alias("_meaning")))
    variants = lexicon.prefix_variants(spark)
    found = choices.join(parts, choices["component_id"] == parts["_id"], "left")
    having = F.broadcast(variants.select(F.col("prefix_id").alias("_has")).distinct())
    one = F.broadcast(variants.select(F.col("prefix_id").alias("_p"), F.col("form").alias("_f"), F.col("note").alias("_n")))
    found = found.join(having, found["_id"] == having["_has"], "left").join(one, (found["_id"] == one["_p"]) & (found["variant"] == one["_f"]), "left")
    two_steps = F.col("_has").isNotNull() & F.col("_category").startswith("Приставки")
    common = {"id": F.expr("uuid()"), "type": F.lit("component"), "label": F.col("_category"), "meaning": F.col("_meaning"), "source_id": F.col("_id"), "category": F.col("_category")}
    plain = _component(**common, form=F.col("_form"))
    varied = _component(**common, form=F.col("_f"), base_form=F.col("_form"), assimilation_note=F.col("_n"))
    made = F.when(F.col("_id").isNull(), None).when(~two_steps, plain).when(F.col("_p").isNotNull(), varied)
    return found.withColumn("component", made).select(*choices.columns, "component")


def summary(components: Column) -> Column:
    """The forms joined by " / "; a dash if there are none."""
    forms = F.array_join(F.transform(components, lambda c: c["form"]), " / ")
    return F.when(F.coalesce(F.size(components), F.lit(0)) > 0, forms).otherwise("—")


def without(components: Column, component_id: Column) -> Column:
    return F.filter(components, lambda c: ~c["id"].eqNullSafe(component_id))


def migrated(components: Column) -> Column:
    """Stored components in today's shape: a root's label is root, another's its category if it has one."""
    text = lambda c: F.nullif(c, F.lit(""))
    return F.transform(components, lambda c: c.withField("label", F.when(c["type"] == "root", "root").otherwise(F.coalesce(text(c["category"]), c["label"]))))
