"""Labels, ids and summaries of modules and components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archtrail.functions import paths
from archtrail.functions.text import SUMMARY_LIMIT, stable_id, title_label
from archtrail.operators.ranking import first_n, ordinal_in_group


def group_profiles(members: DataFrame) -> DataFrame:
    """One row per group: directory, file count, LOC, base label.

    ``members``: group, path, loc, fan_in. All values are plain aggregates, the
    common directory included."""
    entry = F.lower(paths.stem(F.col("path"))).isin(*paths.ENTRY_STEMS)
    leading = F.min_by("path", F.struct(entry.cast("int"), -F.col("fan_in"), F.col("path")))
    profile = members.groupBy("group").agg(
        paths.common_directory(F.col("path")).alias("directory"),
        F.count(F.lit(1)).alias("files"),
        F.sum("loc").cast("bigint").alias("loc"),
        leading.alias("_leading"),
    )
    own_stem = paths.stem(F.col("_leading"))
    label = F.when(F.col("files") == 1, own_stem).otherwise(
        F.coalesce(paths.meaningful_segment(F.col("directory")), own_stem)
    )
    return profile.withColumn("label", title_label(label)).drop("_leading")


def unique_labels(profiles: DataFrame) -> DataFrame:
    """Make labels unique: equal ones get the path segment that tells them apart,
    what is still equal a number from 2 in the order of the groups, leaving out
    numbers with which another label already ends.

    The trailing segments all directories of one label share are the common
    prefix of the reversed directories, again from the smallest and largest."""
    reversed_parts = F.reverse(F.filter(F.split("directory", "/"), lambda part: ~part.isin("", ".")))
    parted = profiles.withColumn("_parts", reversed_parts)
    shared = parted.groupBy("label").agg(
        F.count(F.lit(1)).alias("_same"),
        F.size(paths.common_prefix(F.min("_parts"), F.max("_parts"))).alias("_shared"),
    )
    beyond = F.when(F.col("_shared") < F.size("_parts"), F.col("_shared")).otherwise(F.lit(0))
    segment = title_label(F.try_element_at("_parts", beyond + 1))
    told_apart = F.when(
        (F.col("_same") > 1) & segment.isNotNull(), F.concat("label", F.lit(" / "), segment)
    ).otherwise(F.col("label"))
    labelled = parted.join(shared, "label").withColumn("_label", told_apart)
    numbered = ordinal_in_group(labelled.drop("_parts", "_same", "_shared"), ["_label"], F.col("group"),
                                name="_nth")
    # A label like "Core 3" takes the number 3 from "Core". The k-th number left is k
    # and one for every taken number that does not exceed what it is then.
    number = F.regexp_extract("_label", r" ([2-9]|[1-9]\d{1,8})$", 1)
    taken = (
        numbered.select("_label", number.alias("_number")).where("_number <> ''").distinct()
        .select(F.expr("left(_label, length(_label) - length(_number) - 1)").alias("_label"), F.col("_number").cast("int").alias("_number"))
        .groupBy("_label").agg(F.array_sort(F.collect_set("_number")).alias("_taken"))
    )
    wanted = F.col("_nth") + 1
    skipped = F.size(F.filter(F.transform(F.coalesce("_taken", F.array().cast("array<int>")), lambda e, i: e - i), lambda e: e <= wanted))
    suffix = F.concat(F.lit(" "), (wanted + skipped).cast("string"))
    label = F.when(F.col("_nth") == 0, F.col("_label")).otherwise(F.concat("_label", suffix))
    return numbered.join(taken, "_label", "left").withColumn("label", label).drop("_label", "_nth", "_taken")


def group_ids(prefix: str, profiles: DataFrame, children: DataFrame) -> DataFrame:
    """Add ``id``: from the directory, so it survives changes of membership; where
    several groups share a directory, from the ids of their children.

    ``children``: group, child. Child ids are gathered only for those groups."""
    same = profiles.groupBy("directory").agg(F.count(F.lit(1)).alias("_same"))
    counted = profiles.join(same, "directory")
    shared = counted.where("_same > 1").select("group")
    listed = children.join(shared, "group", "left_semi").groupBy("group").agg(
        F.array_join(F.array_sort(F.collect_list("child")), "\0").alias("_children")
    )
    source: Column = F.when(F.col("_same") == 1, F.col("directory")).otherwise(F.col("_children"))
    return (
        counted.join(listed, "group", "left")
        .withColumn("id", stable_id(prefix, F.col("directory"), source))
        .drop("_same", "_children")
    )


def summaries(profiles: DataFrame, members: DataFrame, facts: DataFrame, headings: DataFrame) -> DataFrame:
    """(group, summary): the package docstring, else the heading of a readme in the
    common directory, else counts and the first exported names.

    ``members``: group, path. ``headings``: directory, heading."""
    told = members.join(facts.select("path", "docstring", "public_names"), "path")
    entry = F.col("path").endswith(".py") & paths.stem(F.col("path")).isin(*paths.ENTRY_STEMS)
    speaking = told.where(entry & (F.length("docstring") > 0))
    docstrings = speaking.groupBy("group").agg(F.min_by("docstring", "path").alias("_docstring"))
    names = told.select("group", F.explode("public_names").alias("_name")).distinct()
    exported = (
        first_n(names, ["group"], [F.col("_name")], 5)
        .groupBy("group")
        .agg(F.array_join(F.array_sort(F.collect_list("_name")), ", ").alias("_exports"))
    )
    noun = F.when(F.col("files") == 1, F.lit(" file, ")).otherwise(F.lit(" files, "))
    counted = F.concat(
        F.col("files").cast("string"), noun, F.col("loc").cast("string"), F.lit(" LOC"),
        F.coalesce(F.concat(F.lit("; exports "), "_exports"), F.lit("")), F.lit("."),
    )
    found = F.left(F.coalesce("_docstring", "heading"), F.lit(SUMMARY_LIMIT))
    return (
        profiles.join(docstrings, "group", "left")
        .join(headings.where("directory <> '.'"), "directory", "left")
        .join(exported, "group", "left")
        .select("group", F.coalesce(found, counted).alias("summary"))
    )


def readme_headings(contents: DataFrame) -> DataFrame:
    """(directory, heading) from readme files; of several in one directory the one
    whose name sorts first counts, as long as it has a heading."""
    text = F.decode(F.col("content"), "UTF-8")
    heading = F.trim(F.regexp_extract(text, r"(?m)^[ \t]*#+[ \t]*([^\s#][^\n\r]*)", 1))
    directory = paths.parent(F.col("path"))
    found = contents.select(directory.alias("directory"), "path", heading.alias("heading"))
    return (
        found.where(F.col("heading") != "")
        .groupBy("directory")
        .agg(F.min_by("heading", "path").alias("heading"))
    )
