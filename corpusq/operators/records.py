"""Structured records: a parent with one stats row and many child rows.

Tables: parents(parent_id, name, metatype, archetype, ...), stats(parent_id,
attributes ...), skills(parent_id, skill_id, name, rating, specialization,
skill_type, attribute), gear(parent_id, gear_id, name, category, quantity,
armor_value, cost).  Child ids are integers.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from corpusq.functions import fixed_values as fv
from corpusq.functions.text import _col, any_term, title_case
from corpusq.plans.nesting import long_form, nest, salted_join
from corpusq.plans.ordered import top_k

ATTRIBUTES = ["body", "agility", "reaction", "strength", "charisma", "logic", "intuition", "willpower", "edge"]


def _has(column) -> Column:
    return F.coalesce(_col(column), F.lit("")) != ""


def attribute_map(attributes=None) -> Column:
    return F.create_map(*[x for a in (attributes or ATTRIBUTES) for x in (F.lit(a), F.col(a).cast("int"))])


def _value(attrs, attribute) -> Column:
    return F.coalesce(F.try_element_at(_col(attrs), F.lower(_col(attribute))), F.lit(0))


def with_dice_pool(skills: DataFrame, stats: DataFrame, attributes=None, how: str = "left") -> DataFrame:
    """Add dice_pool = attribute value + rating, NULL when the skill has no attribute."""
    values = stats.select("parent_id", attribute_map(attributes).alias("_attrs"))
    joined = salted_join(skills, values, ["parent_id"], "skill_id", how)
    return joined.withColumn("dice_pool", F.when(_has("attribute"), _value("_attrs", "attribute") + F.col("rating"))
                             ).drop("_attrs")


def total_armor(parents: DataFrame, gear: DataFrame) -> DataFrame:
    """(parent_id, total_armor), 0 without armour.  Sums combine before the shuffle."""
    sums = gear.filter("armor_value > 0").groupBy("parent_id").agg(
        F.sum(F.col("armor_value") * F.col("quantity")).alias("total_armor"))
    return parents.select("parent_id").join(sums, "parent_id", "left").fillna(0, ["total_armor"])


def _summary_skills(stats: DataFrame, skills: DataFrame, attributes: list[str]):
    """Active skills with their pool, the item of each and the order (rating desc, name)."""
    active = with_dice_pool(skills.filter("skill_type = 'active' AND rating > 0"), stats, attributes)
    item = F.struct("name", "rating", F.nullif(F.col("specialization"), F.lit("")).alias("specialization"),
                    F.nullif(F.col("attribute"), F.lit("")).alias("attribute"), "dice_pool")
    return active, item, [(-F.col("rating")).alias("r"), F.col("name")]


def summary_skills(stats: DataFrame, skills: DataFrame, attributes=None) -> DataFrame:
    """The skills of ``entity_summary`` in long form: (parent_id, position, item), for parents of any size."""
    active, item, order = _summary_skills(stats, skills, attributes or ATTRIBUTES)
    return long_form(active, ["parent_id"], "skill_id", item, order)


def entity_summary(parents: DataFrame, stats: DataFrame, skills: DataFrame, gear: DataFrame, attributes=None) -> DataFrame:
    """Parents that have stats, with active skills (rating desc, name), dice pools and total armour.

    One row per parent, however many skills it has; ``summary_skills`` is the long form.
    """
    attributes = attributes or ATTRIBUTES
    active, item, order = _summary_skills(stats, skills, attributes)
    nested = nest(active, ["parent_id"], "skill_id", item, "skills", order)
    return (parents.join(stats.select("parent_id", F.struct(*attributes).alias("attributes")), "parent_id")
            .join(nested, "parent_id", "left").join(total_armor(parents, gear), "parent_id"))


def _record_item(rows: DataFrame, pos: str) -> Column:
    return F.struct(*[c for c in rows.columns if c not in ("parent_id", pos)])


def record_children(children: dict[str, tuple[DataFrame, str, list[str]]]) -> dict[str, DataFrame]:
    """The children of ``full_record`` in long form: {name: (parent_id, position, item)}, for parents of any size."""
    return {name: long_form(rows, ["parent_id"], pos, _record_item(rows, pos), [F.col(c) for c in order])
            for name, (rows, pos, order) in children.items()}


def full_record(parents: DataFrame, singles: dict[str, DataFrame], children: dict[str, tuple[DataFrame, str, list[str]]],
                skills: str = "skills") -> DataFrame:
    """One nested record per parent, however many children it has; ``record_children`` is the long form.

    ``singles`` {name: one row per parent}; ``children`` {name: (rows, id column, sort columns)}.
    The skills array also becomes a map by type with all three types present.
    """
    nested = {name: nest(rows, ["parent_id"], pos, _record_item(rows, pos), name, [F.col(c) for c in order])
              for name, (rows, pos, order) in children.items()}
    record = parents
    for name, rows in singles.items():
        record = record.join(rows.select("parent_id", F.struct(*[c for c in rows.columns if c != "parent_id"]).alias(name)),
                             "parent_id", "left")
    for name, rows in nested.items():
        empty = F.array().cast(rows.schema[name].dataType)
        record = record.join(rows, "parent_id", "left").withColumn(name, F.coalesce(name, empty))
    if skills in nested:
        def of_type(kind):
            return F.filter(skills, lambda s: s["skill_type"] == kind)
        by_type = [x for kind in ("active", "knowledge", "language") for x in (F.lit(kind), of_type(kind))]
        record = record.withColumn(f"{skills}_by_type", F.create_map(*by_type))
    return record


def skill_dice_pool(requests: DataFrame, parents: DataFrame, stats: DataFrame, skills: DataFrame, attributes=None) -> DataFrame:
    """(parent_id, skill_name) requests with dice_pool and explanation, or 0 and why not."""
    low = F.lower("name").alias("_low")
    first = (skills.filter("skill_type = 'active'").groupBy("parent_id", low)
             .agg(F.min_by(F.struct("rating", "attribute", "specialization"), F.struct("name", "skill_id")).alias("_s")))
    values = stats.select("parent_id", attribute_map(attributes).alias("_attrs"))
    known = parents.select("parent_id", F.lit(True).alias("_known"))
    rows = (requests.withColumn("_low", F.lower("skill_name")).withColumn("_r", F.xxhash64("parent_id", "skill_name")))
    rows = salted_join(rows, known, ["parent_id"], "_r")
    rows = salted_join(rows, first, ["parent_id", "_low"], "_r")
    rows = salted_join(rows, values, ["parent_id"], "_r")
    attribute = F.lower(F.coalesce("_s.attribute", F.lit("")))
    value = F.coalesce(F.try_element_at("_attrs", attribute), F.lit(0))
    spec = F.when(_has("_s.specialization"), F.concat(F.lit(" (+2 for "), "_s.specialization", F.lit(")"))).otherwise("")
    found = F.col("_s").isNotNull()
    text = (F.when(F.col("_known").isNull(), F.lit("Character not found"))
            .when(~found, F.concat(F.lit("Skill '"), "skill_name", F.lit("' not found")))
            .otherwise(F.concat(title_case(attribute), F.lit(" "), value.cast("string"), F.lit(" + "), "skill_name",
                                F.lit(" "), F.col("_s.rating").cast("string"), spec)))
    pool = F.when(F.col("_known").isNotNull() & found, value + F.col("_s.rating")).otherwise(0)
    return rows.select(*requests.columns, pool.alias("dice_pool"), text.alias("explanation"))


def resolve_pool_query(queries: DataFrame, parents: DataFrame, stats: DataFrame, skills: DataFrame, attributes=None,
                       tests=None, gate=None, text: str = "text") -> DataFrame:
    """Answer "what do I roll for ..." texts: (…, answer), NULL when no test is meant.

    Every parent's best skill per test is found first, so queries meet at most one row.
    """
    tests = tests or fv.POOL_TESTS
    low = F.lower(_col(text))
    asked = F
    for name, _, _ in tests:
        asked = asked.when(F.contains(low, F.lit(name)), F.lit(name))
    gated = F.when(any_term(low, gate or fv.POOL_QUERY_GATE), asked.otherwise(F.lit(None).cast("string")))
    meant = F.filter(F.array(*[F.when(F.contains(F.lower("name"), F.lit(skill.lower())), F.lit(name))
                               for name, _, skill in tests]), lambda t: t.isNotNull())
    ratings = (skills.filter("skill_type = 'active'").select("parent_id", "skill_id", "name", "rating", F.explode(meant).alias("test"))
               .groupBy("parent_id", "test").agg(F.min_by("rating", F.struct("name", "skill_id")).alias("rating")))
    values = parents.select("parent_id", F.col("name").alias("_name")).join(
        stats.select("parent_id", attribute_map(attributes).alias("_attrs")), "parent_id", "left")
    rows = queries.withColumn("test", gated).withColumn("_r", F.xxhash64("parent_id", text))
    rows = salted_join(rows, values, ["parent_id"], "_r")
    rows = salted_join(rows, ratings, ["parent_id", "test"], "_r")
    attribute, skill = F, F
    for name, attr, own in tests:
        attribute = attribute.when(F.col("test") == name, F.lit(attr))
        skill = skill.when(F.col("test") == name, F.lit(own))
    rows = rows.withColumn("_a", attribute.otherwise(F.lit(None).cast("string"))).withColumn(
        "_k", skill.otherwise(F.lit(None).cast("string")))
    value, rating = F.coalesce(F.try_element_at("_attrs", F.col("_a")), F.lit(0)), F.coalesce("rating", F.lit(0))
    answer = F.concat(F.col("_name"), F.lit("'s "), "test", F.lit(" test: "), title_case("_a"), F.lit(" "), value.cast("string"),
                      F.lit(" + "), title_case("_k"), F.lit(" "), rating.cast("string"), F.lit(" = "),
                      (value + rating).cast("string"), F.lit(" dice"))
    return rows.select(*queries.columns, F.when(F.col("test").isNotNull(), answer).alias("answer"))


def dice_pool(attribute, rating, specialised, modifiers) -> Column:
    """STRUCT<pool, explanation>; never below 0."""
    attribute, rating, specialised, modifiers = _col(attribute), _col(rating), _col(specialised), _col(modifiers)
    extra = F.aggregate(F.coalesce(modifiers, F.array().cast("array<int>")), F.lit(0), lambda a, m: a + m)
    pool = F.greatest(F.lit(0), attribute + rating + F.when(specialised, 2).otherwise(0) + extra)
    parts = F.filter(F.array(
        F.concat(F.lit("Attribute "), attribute.cast("string")), F.concat(F.lit("Skill "), rating.cast("string")),
        F.when(specialised, "Specialization +2"),
        F.when(extra != 0, F.concat(F.lit("Modifiers "), F.when(extra > 0, "+").otherwise(""), extra.cast("string")))),
        lambda p: p.isNotNull())
    return F.struct(pool.alias("pool"), F.concat(F.array_join(parts, " + "), F.lit(" = "), pool.cast("string"), F.lit(" dice")).alias("explanation"))


def context_line(parents: DataFrame, stats: DataFrame, skills: DataFrame, gear: DataFrame, attributes=None, top: int = 5) -> DataFrame:
    """One line per parent with stats: identity, attributes, best skills by pool, armour."""
    attributes = attributes or ["body", "agility", "logic", "willpower", "charisma", "edge"]
    active = with_dice_pool(skills.filter("skill_type = 'active' AND rating > 0"), stats)
    best = top_k(active, ["parent_id"], [F.coalesce("dice_pool", F.lit(0)).desc(), F.col("rating").desc(), F.col("name"), F.col("skill_id")], top, "_r")
    shown = F.concat("name", F.lit(" "), F.col("rating").cast("string"), F.lit(" ("),
                     F.coalesce("dice_pool", "rating").cast("string"), F.lit(" dice)"))
    lines = best.groupBy("parent_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("_r", shown.alias("t")))), lambda s: s["t"]), ", ").alias("_top"))
    listed = F.array_join(F.array(*[F.concat(F.lit(title + " "), F.col(a).cast("string")) for a, title in
                                    ((a, a.capitalize()) for a in attributes)]), ", ")
    rows = parents.join(stats, "parent_id").join(lines, "parent_id", "left").join(total_armor(parents, gear), "parent_id")
    parts = F.filter(F.array(
        F.concat(F.lit("Active Character: "), "name", F.lit(" ("), "metatype", F.lit(")")),
        F.when(_has("archetype"), F.concat(F.lit("Archetype: "), "archetype")),
        F.concat(F.lit("Attributes: "), listed),
        F.when(F.col("_top").isNotNull(), F.concat(F.lit("Top Skills: "), "_top")),
        F.when(F.col("total_armor") > 0, F.concat(F.lit("Total Armor: "), F.col("total_armor").cast("string")))),
        lambda p: p.isNotNull())
    return rows.select("parent_id", F.array_join(parts, " | ").alias("context_line"))


# ---- change log ---------------------------------------------------------------------------
INSERTS = ["insert", "insert_or_ignore"]
#: Positions of the log that are combined at once; a range holds at most that many inserts of one key.
LOG_RANGE = 4096


def apply_changes(base: DataFrame, log: DataFrame, key: str, payload: list[str], op: str = "op", seq: str = "seq",
                  width: int = LOG_RANGE) -> DataFrame:
    """State after replaying the log in seq order on top of the base rows.

    Inserts of an existing key change nothing, "insert_or_replace" rewrites the
    row, "update" sets its non-NULL columns on an existing row, "delete" removes
    it.  seq is distinct within a key.  Adds touched_seq.

    The log is read once.  A run of changes of a key is summed up by its last
    delete, the first insert after that, its last replacement and the last value
    written to each column; neighbouring runs combine to the same summary.
    Runs are ranges of seq, so a key of any history is spread over many tasks.
    """
    changes = log.withColumn("_range", F.floor(F.col(seq) / F.lit(width)))
    row, at = F.struct(*payload), F.col(seq)

    def last(column, condition, name):
        return [F.max_by(column, F.when(condition, at)).alias(f"_{name}"), F.max(F.when(condition, at)).alias(f"_{name}_at")]
    update, replace = F.col(op) == "update", F.col(op) == "insert_or_replace"
    runs = changes.groupBy(key, "_range").agg(
        F.max(F.when(F.col(op) == "delete", at)).alias("_deleted"), F.max(F.when(update, at)).alias("_updated"),
        F.collect_list(F.when(F.col(op).isin(INSERTS), F.struct(at.alias("at"), row.alias("row")))).alias("_inserts"),
        *last(row, replace, "replaced"), *[x for i, c in enumerate(payload) for x in last(F.col(c), update & F.col(c).isNotNull(), f"set{i}")])

    def after(items, deleted):
        return F.filter(items, lambda i: deleted.isNull() | (i["at"] > deleted))
    # after the last delete of a run only its first insert can matter
    runs = runs.withColumn("_first", F.array_min(after(F.col("_inserts"), F.col("_deleted"))))
    names = ["replaced", *[f"set{i}" for i in range(len(payload))]]
    keys = runs.groupBy(key).agg(
        F.max("_deleted").alias("_deleted"), F.max("_updated").alias("_updated"), F.collect_list("_first").alias("_firsts"),
        *[x for n in names for x in (F.max_by(f"_{n}", f"_{n}_at").alias(f"_{n}"), F.max(f"_{n}_at").alias(f"_{n}_at"))])
    deleted = F.col("_deleted")
    keys = (keys.withColumn("_born", F.array_min(after(F.col("_firsts"), deleted)))
            .withColumn("_replaced_at", F.when(deleted.isNull() | (F.col("_replaced_at") > deleted), F.col("_replaced_at")))
            .join(base.select(key, row.alias("_base")), key, "full_outer"))
    in_base = F.col("_base").isNotNull() & deleted.isNull()
    # the write that all later updates build on (-1: the base row)
    written = F.coalesce("_replaced_at", F.when(in_base, F.lit(-1)), F.col("_born.at"))
    rows = keys.withColumn("_written", written).filter(F.col("_written").isNotNull())
    written = F.col("_written")
    origin = (F.when(written == F.col("_replaced_at"), F.col("_replaced")).when(written < 0, F.col("_base"))
              .otherwise(F.col("_born.row")))
    return rows.withColumn("_origin", origin).select(
        key, *[F.when(F.col(f"_set{i}_at") > written, F.col(f"_set{i}")).otherwise(F.col(f"_origin.{c}")).alias(c) for i, c in enumerate(payload)],
        F.greatest(F.when(written >= 0, written), F.when(F.col("_updated") > written, F.col("_updated"))).alias("touched_seq"))


def cascade_delete(children: DataFrame, parents: DataFrame, key: str, child_id: str) -> DataFrame:
    """Children whose parent still exists."""
    return salted_join(children, parents.select(key).distinct(), [key], child_id, "left_semi")


def touch_parents(parents: DataFrame, changed: DataFrame, key: str, stamp: str = "updated_at") -> DataFrame:
    """Parents with the time of their last child change: changed(key, ts)."""
    last = changed.groupBy(key).agg(F.max("ts").alias("_ts"))
    return parents.join(last, key, "left").withColumn(stamp, F.greatest(stamp, "_ts")).drop("_ts")


def change_counts(before: DataFrame, after: DataFrame, key: str, payload: list[str]) -> DataFrame:
    """How many rows were inserted, updated and deleted."""
    a = before.select(key, F.struct(*payload).alias("_a"))
    b = after.select(key, F.struct(*payload).alias("_b"))
    both = a.join(b, key, "full_outer")
    return both.agg(F.count_if(F.col("_a").isNull()).alias("inserted"), F.count_if(F.col("_b").isNull()).alias("deleted"),
                    F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull() & (F.col("_a") != F.col("_b"))).alias("updated"))


# ---- defaults, views, checks ------------------------------------------------------------------
def defaults_fill(df: DataFrame, defaults: dict | None = None) -> DataFrame:
    defaults = fv.STAT_DEFAULTS if defaults is None else defaults
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v).cast(df.schema[c].dataType))
                           for c, v in defaults.items() if c in df.columns})


TABLE_VIEWS = {
    "skills": ["name", "rating", "specialization", "skill_type", "dice_pool"],
    "qualities": ["name", "rating", "quality_type"],
    "gear": ["name", "quantity", "category", "armor_value"],
    "weapons": ["name", "weapon_type", "damage_code", "armor_penetration"],
    "vehicles": ["name", "vehicle_type", "handling", "speed"],
    "programs": ["name", "rating", "program_type"],
}


def table_view(rows: DataFrame, kind: str, stats: DataFrame | None = None, attributes=None) -> DataFrame:
    """Display columns of a child table; skills show the pool, or the rating when there is no attribute."""
    if kind == "skills":
        pooled = with_dice_pool(rows, stats, attributes)
        rows = pooled.withColumn("dice_pool", F.coalesce("dice_pool", "rating"))
    return rows.select("parent_id", *TABLE_VIEWS[kind])


def name_error(column) -> Column:
    """NULL for a valid name, else the message."""
    name = F.regexp_replace(F.coalesce(_col(column), F.lit("")), r"(?U)^\s+|\s+$", "")
    return (F.when(name == "", "Character name is required")
            .when(F.length(name) < 2, "Character name must be at least 2 characters")
            .when(F.length(name) > 50, "Character name must be less than 50 characters"))


def number_error(column, field: str, low=None, high=None) -> Column:
    number = _col(column).try_cast("double")
    chain = F.when(number.isNull(), f"{field} must be a valid number")
    if low is not None:
        chain = chain.when(number < low, f"{field} must be at least {low}")
    if high is not None:
        chain = chain.when(number > high, f"{field} must be no more than {high}")
    return chain


def validate_rows(df: DataFrame, name: str, numbers: dict[str, tuple]) -> DataFrame:
    """Add errors: ``numbers`` {column: (label, min, max)}."""
    checks = [name_error(name)] + [number_error(c, *rule) for c, rule in numbers.items()]
    return df.withColumn("errors", F.filter(F.array(*checks), lambda e: e.isNotNull()))


def active_selection(settings: DataFrame, parents: DataFrame, key: str = "key", value: str = "value", seq: str = "seq") -> DataFrame:
    """Last written value per setting, joined to the parent it names."""
    last = settings.groupBy(key).agg(F.max_by(value, seq).alias(value))
    return last.join(parents, last[value] == parents["parent_id"].cast("string"))
