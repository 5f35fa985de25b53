"""Record exports: JSON envelope, sectioned CSV lines, text summary."""

from pyspark.sql import Column, DataFrame, functions as F

from corpusq.operators.records import ATTRIBUTES, with_dice_pool
from corpusq.plans.ordered import top_k


def export_json(records: DataFrame, exported_at: Column | None = None, exported_from: str = "corpusq",
                format_version: str = "1.0", key: str = "parent_id") -> DataFrame:
    """(parent_id, part, json) with an envelope around the nested record."""
    stamp = F.current_timestamp() if exported_at is None else exported_at
    info = F.struct(F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss").alias("exported_at"), F.lit(exported_from).alias("exported_from"),
                    F.lit(format_version).alias("format_version"))
    body = F.struct(*[c for c in records.columns if c != "part"])
    part = F.col("part") if "part" in records.columns else F.lit(0).cast("long")
    return records.select(key, part.alias("part"), F.to_json(
        F.struct(info.alias("export_info"), body.alias("character")), {"ignoreNullFields": "false"}).alias("json"))


def _csv(*cells) -> Column:
    """One CSV line; a cell with a comma, quote or line break is quoted."""
    def cell(c):
        text = F.coalesce(c.cast("string"), F.lit(""))
        return F.when(F.rlike(text, F.lit('[",\\n\\r]')), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)
    return F.concat_ws(",", *[cell(c if isinstance(c, Column) else F.lit(c)) for c in cells])


def export_csv_sections(parents: DataFrame, stats: DataFrame, skills: DataFrame, qualities: DataFrame, gear: DataFrame,
                        attributes=None) -> DataFrame:
    """(parent_id, section_ord, row_ord, line): header block, ATTRIBUTES, ACTIVE SKILLS, QUALITIES, GEAR.

    Long form in file order, so that writing needs no group in one task.
    """
    attributes = attributes or ATTRIBUTES + ["essence"]
    name = F.col("name")

    def fixed(df, section, lines):
        return df.select("parent_id", F.lit(section).alias("section_ord"), F.posexplode(F.array(*lines)).alias("i", "line")).select(
            "parent_id", "section_ord", (F.col("i").cast("long") - len(lines)).alias("row_ord"), "line")

    def rows(df, section, pos, line):
        return df.select("parent_id", F.lit(section).alias("section_ord"), F.col(pos).cast("long").alias("row_ord"), line.alias("line"))

    pooled = with_dice_pool(skills.filter("skill_type = 'active'"), stats)
    out = [
        fixed(parents, 0, [_csv("Character", name), _csv("Metatype", F.col("metatype")), _csv("Archetype", F.col("archetype")), F.lit("")]),
        fixed(stats, 1, [F.lit("ATTRIBUTES")] + [_csv(a.capitalize(), F.col(a)) for a in attributes] + [F.lit("")]),
        fixed(parents, 2, [F.lit("ACTIVE SKILLS"), F.lit("Skill,Rating,Specialization,Dice Pool")]),
        rows(pooled, 2, "skill_id", _csv(name, F.col("rating"), F.col("specialization"), F.coalesce("dice_pool", "rating"))),
        fixed(parents, 3, [F.lit(""), F.lit("QUALITIES"), F.lit("Quality,Rating,Type,Cost")]),
        rows(qualities, 3, "quality_id", _csv(name, F.col("rating"), F.col("quality_type"), F.col("karma_cost"))),
        fixed(parents, 4, [F.lit(""), F.lit("GEAR"), F.lit("Item,Quantity,Category,Armor,Cost")]),
        rows(gear, 4, "gear_id", _csv(name, F.col("quantity"), F.col("category"), F.col("armor_value"), F.col("cost")))]
    merged = out[0]
    for df in out[1:]:
        merged = merged.unionByName(df)
    return merged


def export_text_summary(parents: DataFrame, stats: DataFrame, skills: DataFrame, top: int = 10, attributes=None) -> DataFrame:
    """(parent_id, summary): identity, attributes and the best skills by rating."""
    attributes = attributes or ["body", "agility", "reaction", "strength", "willpower", "logic", "intuition", "charisma"]
    best = top_k(skills.filter("skill_type = 'active'"), ["parent_id"], [F.col("rating").desc(), F.col("name"), F.col("skill_id")], top, "_r")
    lines = best.groupBy("parent_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(
        "_r", F.concat(F.lit("  "), "name", F.lit(": "), F.col("rating").cast("string")).alias("t")))), lambda s: s["t"]), "\n").alias("_skills"))
    rows = parents.join(stats, "parent_id", "left").join(lines, "parent_id", "left")
    shown = [F.concat(F.lit(f"  {a.capitalize()}: "), F.coalesce(F.col(a), F.lit(0)).cast("string")) for a in attributes]
    parts = F.filter(F.array(
        F.concat(F.lit("Character: "), F.coalesce("name", F.lit("Unknown"))),
        F.concat(F.lit("Metatype: "), F.coalesce("metatype", F.lit("Human"))),
        F.concat(F.lit("Archetype: "), F.coalesce("archetype", F.lit("")), F.lit("\n")),
        F.lit("ATTRIBUTES:"), *shown,
        F.concat(F.lit("  Edge: "), F.coalesce(F.col("edge"), F.lit(1)).cast("string")),
        F.concat(F.lit("  Essence: "), F.coalesce(F.col("essence"), F.lit(6.0)).cast("string"), F.lit("\n")),
        F.when(F.col("_skills").isNotNull(), F.concat(F.lit("TOP SKILLS:\n"), "_skills", F.lit("\n")))), lambda p: p.isNotNull())
    return rows.select("parent_id", F.array_join(parts, "\n").alias("summary"))


def write_csv_lines(lines: DataFrame, path: str) -> None:
    """One text file set in (parent, section, row) order, range-partitioned, so size is no limit."""
    (lines.repartitionByRange("parent_id", "section_ord", "row_ord")
     .sortWithinPartitions("parent_id", "section_ord", "row_ord").select("line").write.mode("overwrite").text(path))
