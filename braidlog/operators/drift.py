"""Schemas that drift between files: versioned fingerprints, migration steps, one consistent table.

Lines are JSON objects grouped by file and record type.  A registry lists the members each record type
should have.  The operator

1. reduces every readable line to its *shape* (the sorted paths and JSON types of its members) and counts
   equal shapes per file and record type, so that later work follows the number of distinct shapes;
2. gives each file and record type a *version*: the fingerprint of its set of shapes.  Files written alike share a version,
   and everything that follows is worked out once per version, however many files have it;
3. compares a version with the registry and writes its *changes* (``renamed``, ``retyped``, ``missing``, ``added``), and from these
   its explicit *migration steps*, in the order in which they are applied: rename, default, cast, rest;
4. routes each line through the chain of its file's version: an absent member is taken from its new name, then from its
   default, then cast to the registered type; whatever has no place goes to a rest column, and every cast that failed is named.

``versions`` numbers the versions of a record type by first appearance and says what changed since the one before.
Everything is built-in expressions on VARIANT; no Python runs per row.

Defined results: null, unreadable or non-object payloads take part in nothing (they come out of the table
with ``readable`` false and null members); a null member counts as absent; an empty table gives no changes;
repeated lines count as lines; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["tbl", "archive_path", "record_type"]
#: Record types whose name also carries payload.type (fixed values).
TYPED = ["response_item", "event_msg"]
#: The one member below payload whose own members are registered.
NESTED = "item"


def _kind(v: Column) -> Column:
    """JSON type of a variant: string, number, boolean, object, array; null for JSON null and for none."""
    s = F.schema_of_variant(v)
    return (
        F.when(v.isNull(), F.lit(None))
        .when(s == "STRING", "string")
        .when(s == "BOOLEAN", "boolean")
        .when(s.startswith("OBJECT"), "object")
        .when(s.startswith("ARRAY"), "array")
        .when(s == "VOID", F.lit(None))
        .otherwise("number")
    )


def _members(v: Column) -> Column:
    """Members of a variant object as map<string,variant>; null for anything else."""
    return F.when(F.schema_of_variant(v).startswith("OBJECT"), F.try_variant_get(v, "$", "map<string,variant>"))


def parsed_lines(lines: DataFrame, tbl: str) -> DataFrame:
    """One row per line with its record type and its members as variants (null where unreadable)."""
    v = F.try_parse_json("payload")
    at = F.unix_micros(F.col("ingested_at").cast("timestamp")) if "ingested_at" in lines.columns else F.lit(None).cast("long")
    df = lines.select(F.lit(tbl).alias("tbl"), "row_id", "archive_path", "line", "type", v.alias("v"), at.alias("at"))
    df = df.withColumn("members", _members(F.col("v")))
    sub = F.try_variant_get("v", "$.type", "string")
    record = F.when(F.col("type").isin(TYPED), F.concat_ws("/", "type", sub)).otherwise(F.col("type"))
    return df.select("tbl", "row_id", "archive_path", "line", record.alias("record_type"), "members", "at")


def _flat(members: Column, inner: Column) -> Column:
    """Sorted array of (path, kind) of all non-null members, ``inner`` being those of the nested one."""
    a = F.transform(F.map_entries(members), lambda e: F.struct(F.concat(F.lit("payload."), e["key"]).alias("path"), _kind(e["value"]).alias("kind")))
    b = F.transform(
        F.map_entries(inner),
        lambda e: F.struct(F.concat(F.lit(f"payload.{NESTED}."), e["key"]).alias("path"), _kind(e["value"]).alias("kind")),
    )
    both = F.concat(a, F.coalesce(b, F.array().cast("array<struct<path:string,kind:string>>")))
    return F.array_sort(F.filter(both, lambda e: e["kind"].isNotNull()))


def shapes(parsed: DataFrame) -> DataFrame:
    """Distinct shapes per file and record type, with their number of lines and first appearance."""
    df = parsed.where("members is not null and record_type is not null and archive_path is not null")
    df = df.withColumn("shape", _flat(F.col("members"), _members(F.try_element_at("members", F.lit(NESTED)))))
    return df.groupBy(*KEY, "shape").agg(F.count("*").alias("n"), F.min("at").alias("at"))


VERSION = ["tbl", "record_type", "fingerprint"]


def file_versions(shape_counts: DataFrame) -> DataFrame:
    """``KEY``, fingerprint, shapes, n (lines), at: the version of each record type in each file."""
    per = shape_counts.withColumn("print", F.sha2(F.to_json("shape"), 256)).groupBy(*KEY).agg(
        F.array_sort(F.collect_list(F.struct("print", "shape"))).alias("all"), F.sum("n").alias("n"), F.min("at").alias("at")
    )
    prints = F.transform("all", lambda x: x["print"])
    return per.select(*KEY, F.sha2(F.array_join(prints, ","), 256).alias("fingerprint"), F.transform("all", lambda x: x["shape"]).alias("shapes"), "n", "at")


def known_versions(of_files: DataFrame) -> DataFrame:
    """``VERSION``, shapes, n_lines, n_files, at: each version once."""
    return of_files.groupBy(*VERSION).agg(F.first("shapes").alias("shapes"), F.sum("n").alias("n_lines"), F.count("*").alias("n_files"), F.min("at").alias("at"))


def versions(of_files: DataFrame) -> DataFrame:
    """The versions of each record type, numbered by first appearance, with the members gained and lost since the one before.

    The order within one record type is over its distinct versions only, whose number doesn't follow the number of
    lines or files.
    """
    w = Window.partitionBy("tbl", "record_type").orderBy("at", "fingerprint")
    members = F.array_sort(F.array_distinct(F.flatten("shapes")))
    df = known_versions(of_files).withColumn("members", members)
    df = df.withColumns({"version": F.row_number().over(w).cast("long"), "before": F.coalesce(F.lag("members").over(w), F.array().cast("array<struct<path:string,kind:string>>"))})
    named = lambda x: F.array_join(F.transform(x, lambda m: F.concat(m["path"], F.lit(":"), m["kind"])), ",")
    return df.select("tbl", "record_type", "version", "fingerprint", "n_lines", "n_files", named(F.array_except("members", "before")).alias("gained"), named(F.array_except("before", "members")).alias("lost"))


def _parent(path: Column) -> Column:
    return F.regexp_replace(path, r"\.[^.]*$", "")


def changes(known: DataFrame, registry: DataFrame) -> DataFrame:
    """The changes of each version: ``VERSION``, field_path, change, json_type (registered), and new_path for a renamed member.

    A member's lines are told apart by the *set of shapes* that have it, so the work follows the distinct shapes of
    distinct versions.  ``registry`` is joined on the record type; its size is the number of registered members.
    """
    ranked = known.select(*VERSION, F.size("shapes").alias("of"), F.posexplode("shapes").alias("sid", "shape"))
    total = known.select(*VERSION, F.transform(F.sequence(F.lit(1), F.size("shapes")), lambda i: i - 1).alias("all_sids"))
    seen = (
        ranked.select(*VERSION, "sid", F.explode("shape").alias("m"))
        .select(*VERSION, "sid", F.col("m.path").alias("field_path"), F.col("m.kind").alias("kind"))
        .groupBy(*VERSION, "field_path")
        .agg(F.array_sort(F.collect_list("sid")).alias("sids"), F.collect_set("kind").alias("kinds"))
    )
    reg = registry.select("tbl", "record_type", "field_path", "json_type", "required").dropDuplicates(["tbl", "record_type", "field_path"])
    listed = total.join(reg, ["tbl", "record_type"]).join(seen, [*VERSION, "field_path"], "left")
    listed = listed.withColumn("absent", F.array_except("all_sids", F.coalesce("sids", F.array().cast("array<int>"))))
    retyped = listed.where(F.exists("kinds", lambda k: k != F.col("json_type"))).select(*VERSION, "field_path", F.lit("retyped").alias("change"))
    foreign = seen.join(reg, ["tbl", "record_type", "field_path"], "left_anti")
    gone = listed.where(F.col("required") & (F.size("absent") > 0)).select(
        *VERSION, "field_path", "json_type", F.array_sort("absent").alias("sids"), (F.size("absent") == F.size("all_sids")).alias("never"), _parent(F.col("field_path")).alias("parent")
    )
    single = foreign.where(F.size("kinds") == 1).select(
        *VERSION, F.col("field_path").alias("new_path"), "sids", F.element_at("kinds", 1).alias("json_type"), _parent(F.col("field_path")).alias("parent")
    )
    match = gone.join(single, [*VERSION, "parent", "json_type", "sids"], "left").groupBy(*VERSION, "field_path", "never").agg(
        F.count("new_path").alias("k"), F.min("new_path").alias("new_path")
    )
    renamed = match.where("k = 1").select(*VERSION, "field_path", F.lit("renamed").alias("change"), "new_path")
    missing = match.where("k <> 1 and never").select(*VERSION, "field_path", F.lit("missing").alias("change"))
    taken = renamed.select(*VERSION, F.col("new_path").alias("field_path")).distinct()
    added = foreign.join(taken, [*VERSION, "field_path"], "left_anti").select(*VERSION, "field_path", F.lit("added").alias("change"))
    none = F.lit(None).cast("string").alias("new_path")
    out = renamed
    for part in (retyped, missing, added):
        out = out.unionByName(part.withColumn("new_path", none))
    return out.join(reg.select("tbl", "record_type", "field_path", "json_type"), ["tbl", "record_type", "field_path"], "left")


def of_files(found: DataFrame, per_file: DataFrame) -> DataFrame:
    """The changes of each file: ``KEY``, field_path, change."""
    return per_file.select(*KEY, "fingerprint").join(found, VERSION).select(*KEY, "field_path", "change")


#: change -> (place in the chain, rule)
RULES = {"renamed": (1, "rename"), "missing": (2, "default"), "retyped": (3, "cast"), "added": (4, "rest")}


def steps(found: DataFrame) -> DataFrame:
    """``VERSION``, place, rule, field_path, argument: the migration of each version, to be applied in order of place.

    rename: the new name to read; default: the value for an absent member (null); cast: the registered type; rest: none.
    """
    place, rule, argument = F.lit(None).cast("int"), F.lit(None).cast("string"), F.lit(None).cast("string")
    for change, (k, name) in RULES.items():
        here = F.col("change") == change
        place, rule = F.when(here, k).otherwise(place), F.when(here, name).otherwise(rule)
    argument = F.when(F.col("change") == "renamed", F.col("new_path")).when(F.col("change") == "retyped", F.col("json_type")).otherwise(argument)
    return found.select(*VERSION, place.cast("long").alias("place"), rule.alias("rule"), "field_path", argument.alias("argument"))




def consistent_table(parsed: DataFrame, per_file: DataFrame, migration: DataFrame, registry_rows: list[tuple[str, str]], defaults: dict[str, str] | None = None) -> DataFrame:
    """All lines with one column per registered member, routed through the steps of their file's version.

    ``registry_rows``: (field_path, json_type), a bounded registry, which fixes the columns, named by the path with dots as
    underscores.  ``defaults``: field_path -> JSON text for absent members; null where there is none.  ``version`` is the
    fingerprint of the file's schema; ``rest`` holds all members without a place, as JSON; ``failed`` names the members whose
    value couldn't be cast (it stands in ``rest`` too, so nothing is lost); ``applied`` the rules that changed the line.
    """
    chain = migration.groupBy(*VERSION).agg(
        F.map_from_entries(F.collect_list(F.when(F.col("rule") == "rename", F.struct("field_path", "argument")))).alias("renames"),
    )
    routed = per_file.select(*KEY, "fingerprint").join(chain, VERSION, "left").select(*KEY, F.col("fingerprint").alias("version"), "renames")
    df = parsed.withColumn("inner", _members(F.try_element_at("members", F.lit(NESTED)))).join(routed, KEY, "left")
    df = df.withColumn("renames", F.coalesce("renames", F.create_map().cast("map<string,string>")))
    kinds: dict[str, str] = {}
    for path, kind in sorted(registry_rows):
        kinds[path] = kind if kinds.get(path, kind) == kind else "string"
    holder = lambda path: F.col("inner" if path.startswith(f"payload.{NESTED}.") else "members")
    last = lambda path: F.element_at(F.split(path, r"\."), -1)
    # the chain, one projection per rule: rename, default, cast
    renamed = {p: F.when(_kind(F.try_element_at(holder(p), F.lit(p.split(".")[-1]))).isNull(), F.try_element_at(holder(p), last(F.try_element_at(F.col("renames"), F.lit(p))))) for p in kinds}
    df = df.select("*", *[x.alias(f"renamed_{i}") for i, x in enumerate(renamed.values())])
    found = []
    for i, p in enumerate(kinds):
        own = F.try_element_at(holder(p), F.lit(p.split(".")[-1]))
        default = (defaults or {}).get(p)
        x = F.when(_kind(own).isNotNull(), own).when(_kind(F.col(f"renamed_{i}")).isNotNull(), F.col(f"renamed_{i}"))
        found.append((x if default is None else x.otherwise(F.parse_json(F.lit(default)))).alias(f"found_{i}"))
    df = df.select("*", *found)

    def cast(i: int, kind: str) -> Column:
        v = F.col(f"found_{i}")
        if kind in ("object", "array"):
            return F.when(_kind(v) == kind, F.to_json(v))
        if kind == "string":
            return F.when(_kind(v) == "string", F.try_variant_get(v, "$", "string")).when(_kind(v).isNotNull(), F.to_json(v))
        return F.try_variant_get(v, "$", {"number": "double", "boolean": "boolean"}[kind])

    df = df.select("*", *[cast(i, k).alias(f"cast_{i}") for i, k in enumerate(kinds.values())])
    some = lambda xs: F.array_join(F.filter(F.array(*xs), lambda x: x.isNotNull()), ",")
    failed = some([F.when(_kind(F.col(f"found_{i}")).isNotNull() & F.col(f"cast_{i}").isNull(), p) for i, p in enumerate(kinds)])
    applied = some([F.when(_kind(F.col(f"renamed_{i}")).isNotNull(), f"rename {p}") for i, p in enumerate(kinds)] + [F.when(_kind(F.col(f"found_{i}")) != k, f"cast {p}") for i, (p, k) in enumerate(kinds.items())])

    def unplaced(members: str, base: str, nested: bool) -> Column:
        """Members that no column has: neither registered and cast nor read under a new name."""
        mine = [p for p in kinds if p.startswith(f"payload.{NESTED}.") == nested]
        taken = F.array_compact(F.array(*[F.when(~F.coalesce(F.col(f"cast_{i}").isNull(), F.lit(True)), p) for i, p in enumerate(kinds) if p in mine])) if mine else F.array().cast("array<string>")
        taken = F.array_union(taken, F.array_compact(F.array(*[F.when(_kind(F.col(f"renamed_{i}")).isNotNull() & F.col(f"cast_{i}").isNotNull(), F.try_element_at(F.col("renames"), F.lit(p))) for i, p in enumerate(kinds) if p in mine]))) if mine else taken
        left = F.map_filter(F.coalesce(members, F.create_map().cast("map<string,variant>")), lambda k, v: ~F.array_contains(taken, F.concat(F.lit(base), k)) & _kind(v).isNotNull())
        entries = F.transform(F.map_entries(left), lambda e: F.struct(F.concat(F.lit(base), e["key"]).alias("path"), F.to_json(e["value"]).alias("value")))
        return entries

    rest = F.concat(unplaced("members", "payload.", False), unplaced("inner", f"payload.{NESTED}.", True))
    rest = F.filter(rest, lambda e: e["path"] != f"payload.{NESTED}") if any(p.startswith(f"payload.{NESTED}.") for p in kinds) and f"payload.{NESTED}" not in kinds else rest
    return df.select(
        "tbl", "row_id", "archive_path", "line", "record_type", F.col("members").isNotNull().alias("readable"), "version", *[F.col(f"cast_{i}").alias(p.replace(".", "_")) for i, p in enumerate(kinds)],
        F.to_json(F.map_from_entries(F.array_sort(rest))).alias("rest"), failed.alias("failed"), applied.alias("applied"),
    )
