"""Schemas that drift between files (general problem 4).

Each line is parsed once into a variant.  A file's layout is a small profile (field, type, records), its sorted form
the schema fingerprint of that version.  Files of a feed are compared in order; the differences become explicit
migration steps (rename, add, remove, retype).  Chained through the files, the renames give every file a route from
its own names to the names of the one consistent table, in which the values are cast and missing ones defaulted.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliomill.session import lookup_side, materialize, tasks

#: A file has a field if at least this share of its records hold the key.
PRESENT_SHARE = 0.2
#: Names that never change; they identify a point.
IDENTITY = ("file_path", "chunk_index")

_TYPE = """
CASE WHEN t = 'BIGINT' THEN 'integer'
     WHEN t LIKE 'DECIMAL%' OR t IN ('DOUBLE', 'FLOAT') THEN 'number'
     WHEN t = 'STRING' THEN 'string'
     WHEN t = 'BOOLEAN' THEN 'boolean'
     WHEN t LIKE 'OBJECT%' THEN 'object'
     WHEN t = 'ARRAY<BIGINT>' THEN 'array<integer>'
     WHEN t = 'ARRAY<STRING>' THEN 'array<string>'
     WHEN t LIKE 'ARRAY<DECIMAL%' OR t IN ('ARRAY<DOUBLE>', 'ARRAY<FLOAT>') THEN 'array<number>'
     WHEN t = 'ARRAY<VOID>' OR t = 'VOID' THEN NULL
     WHEN t LIKE 'ARRAY%' THEN 'array<mixed>'
     ELSE lower(t) END
"""


# White space of any kind and the byte order mark, which may stand around a line's object.
_BLANK = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def parse_lines(raw: DataFrame) -> DataFrame:
    """``feed, file_no, line_no, received_at, v`` of the lines that are whole JSON objects; a line repeated within its file counts once.

    White space of any kind around an object is ignored.  Null, empty, cut off and non-object lines are left out; of
    repeated lines the one with the smallest line_no stays.  The lines are parsed here, once, and written to the shared
    folder for the readers that follow.
    """
    clean = raw.select("feed", "file_no", "line_no", "received_at", F.btrim("raw", F.lit(_BLANK)).alias("raw")).where(
        F.col("raw").startswith("{") & F.col("raw").endswith("}") & F.col("feed").isNotNull() & F.col("file_no").isNotNull()
    )
    once = clean.groupBy("feed", "file_no", "raw").agg(F.min("line_no").alias("line_no"), F.min("received_at").alias("received_at"))
    return materialize(once.select("feed", "file_no", "line_no", "received_at", F.expr("try_parse_json(raw)").alias("v")).where(F.col("v").isNotNull()), "lines")


def layouts(lines: DataFrame) -> DataFrame:
    """One row per file and field it has: ``feed, file_no, before_no, field, kind`` (kind null: null throughout).

    ``before_no`` is the feed's file before, -1 for its first.  Ties between types are broken by a fixed hash of the type's name.
    """
    fields = lines.sparkSession.sql(
        f"SELECT feed, file_no, field, {_TYPE} AS kind, count(*) AS n FROM ("
        f"SELECT feed, file_no, key AS field, schema_of_variant(value) AS t FROM {{lines}}, LATERAL variant_explode(v)) GROUP BY ALL",
        lines=lines,
    )
    order = Window.partitionBy("feed").orderBy("file_no")
    files = (
        lines.groupBy("feed", "file_no").agg(F.count(F.lit(1)).alias("records"))
        .withColumn("before_no", F.coalesce(F.lag("file_no").over(order), F.lit(-1)))
    )
    return (
        fields.groupBy("feed", "file_no", "field")
        .agg(F.sum("n").alias("held"), F.expr("max_by(kind, struct(n, -hash(kind))) FILTER (WHERE kind IS NOT NULL)").alias("kind"))
        .join(files, ["feed", "file_no"])
        .where(F.col("held") >= PRESENT_SHARE * F.col("records"))
        .select("feed", "file_no", "before_no", "field", "kind", "held", "records")
    )


def rename_evidence(lines: DataFrame, layout: DataFrame) -> DataFrame:
    """``feed, file_no, old, new, both, same`` for each field that goes against each that comes in the same file.

    both: points (file_path, chunk_index) that the two files hold with values; same: those whose value is equal.
    """
    now = layout.select("feed", "file_no", "before_no", "field")
    files = layout.select("feed", "file_no", "before_no").distinct()
    was = files.join(layout.select("feed", F.col("file_no").alias("before_no"), "field"), ["feed", "before_no"])
    key = ["feed", "file_no", "before_no", "field"]
    gone = was.join(now, key, "left_anti").withColumnRenamed("field", "old")
    come = now.where("before_no >= 0").join(was, key, "left_anti").withColumnRenamed("field", "new")
    fixed = list(IDENTITY)
    pairs = materialize(gone.where(~F.col("old").isin(fixed)).join(come.where(~F.col("new").isin(fixed)), ["feed", "file_no", "before_no"]), "pairs")
    # only the fields that may have been renamed are laid out, and only those of the files that hold them
    asked = pairs.select("feed", "file_no", F.col("new").alias("field")).union(pairs.select("feed", F.col("before_no").alias("file_no"), F.col("old").alias("field")))
    asked = lookup_side(asked.groupBy("feed", "file_no").agg(F.collect_set("field").alias("asked")))
    held = lines.join(asked, ["feed", "file_no"]).selectExpr(
        "feed", "file_no", "asked", "CAST(v AS map<string, variant>) AS vm", "try_variant_get(v, '$.file_path', 'string') AS p", "try_variant_get(v, '$.chunk_index', 'string') AS c"
    ).where("p <> '' AND c IS NOT NULL")
    values = (
        held.select("feed", "file_no", "p", "c", "vm", F.explode("asked").alias("field"))
        .selectExpr("feed", "file_no", "field", "p", "c", "IF(is_variant_null(vm[field]), NULL, CAST(vm[field] AS string)) AS val").where("val IS NOT NULL")
    )
    names = lookup_side(pairs)
    left = values.withColumnsRenamed({"file_no": "before_no", "field": "old", "val": "a"}).join(names, ["feed", "before_no", "old"])
    right = values.withColumnsRenamed({"field": "new", "val": "b"})
    point = ["feed", "file_no", "old", "new", "p", "c"]
    met = left.join(right, ["feed", "file_no", "new", "p", "c"]).groupBy(*point).agg(F.max(F.col("a") == F.col("b")).alias("eq"))
    return met.groupBy("feed", "file_no", "old", "new").agg(F.count(F.lit(1)).alias("both"), F.count_if("eq").alias("same"))


def _walk_feed(feed: str, layout: list, evidence: list) -> list[tuple]:
    """Walk a feed's layouts in order; rows: migration steps, and one ``route`` per file and field (detail = name in the table)."""
    out: list[tuple] = []
    same: dict[int, list[tuple]] = {}
    for e in evidence:
        if 2 * e["same"] > e["both"]:
            same.setdefault(e["file_no"], []).append((-e["same"] / e["both"], -e["same"], e["old"], e["new"]))
    files: dict[int, dict[str, str | None]] = {}
    for x in layout:
        files.setdefault(x["file_no"], {})[x["field"]] = x["kind"]
    known: dict[str, str | None] = {}  # last known type of each field name
    route: dict[str, str] = {}  # field name -> name in the consistent table
    before: set[str] | None = None
    for no in sorted(files):
        kinds = files[no]
        now = set(kinds)
        if before is None:
            route = {f: f for f in now}
        else:
            gone, come = before - now, now - before
            renamed: dict[str, str] = {}
            for _, _, old, new in sorted(same.get(no, [])):
                if old in gone and new in come:
                    renamed[new] = old
                    gone.discard(old)
                    come.discard(new)
                    out.append((feed, no, "renamed", old, new))
            for f in sorted(gone):
                out.append((feed, no, "removed", f, ""))
            for f in sorted(come):
                out.append((feed, no, "added", f, ""))
                known.pop(f, None)
            for new, old in renamed.items():
                known[new] = known.get(old)
            for f in sorted(now & before):
                if kinds[f] and known.get(f) and kinds[f] != known[f]:
                    out.append((feed, no, "retyped", f, kinds[f]))
            route = {f: route.get(renamed[f], renamed[f]) if f in renamed else route.get(f, f) for f in now}
        for f, k in sorted(kinds.items()):
            if k:
                known[f] = k
            known.setdefault(f, None)
            out.append((feed, no, "route", f, route[f]))
        before = now
    return out


def _walk_feeds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = [x for feed, layout, evidence in zip(b["feed"], b["layout"], b["evidence"], strict=True) for x in _walk_feed(feed, list(layout), [] if evidence is None else list(evidence))]
        if out:
            yield pd.DataFrame(out, columns=_STEPS)


_STEPS = ["feed", "file_no", "change", "field", "detail"]


def migration_steps(raw: DataFrame) -> DataFrame:
    """All steps of all feeds, with the rows ``route`` that lead each file's names to the table's names."""
    return _steps_of(parse_lines(raw))


def _steps_of(lines: DataFrame) -> DataFrame:
    layout = materialize(layouts(lines), "layouts")  # small, and read several times
    evidence = materialize(rename_evidence(lines, layout), "renames")
    # a feed's layouts are a row of files x fields, far smaller than its records; the feeds are dealt evenly to the tasks
    feeds = layout.groupBy("feed").agg(F.collect_list(F.struct("file_no", "field", "kind")).alias("layout"))
    met = evidence.groupBy("feed").agg(F.collect_list(F.struct("file_no", "old", "new", "both", "same")).alias("evidence"))
    return (
        feeds.join(met, "feed", "left").repartition(tasks(lines.sparkSession), "feed")
        .mapInPandas(_walk_feeds, "feed string, file_no int, change string, field string, detail string")
    )


def schema_changes(raw: DataFrame) -> DataFrame:
    """Report of every field added, removed, renamed or retyped: ``feed, file_no, change, field, detail``.

    Defined cases: broken lines, null lines and lines that are no objects are ignored; a file without a whole record is
    passed over; a feed's first file reports nothing; an empty table gives no rows; an empty list says nothing about
    a type; of several possible new names the one with most equal values is taken, each name once.
    """
    return migration_steps(raw).where("change <> 'route'")


def fingerprints(raw: DataFrame) -> DataFrame:
    """Version of each file's layout: ``feed, file_no, fields, fingerprint`` (equal layouts have equal fingerprints)."""
    entries = F.array_sort(F.collect_list(F.concat_ws(":", "field", F.coalesce("kind", F.lit("null")))))
    return (
        layouts(parse_lines(raw)).groupBy("feed", "file_no")
        .agg(F.count(F.lit(1)).alias("fields"), F.sha2(F.concat_ws(",", entries), 256).alias("fingerprint"))
    )


def _range(name: str) -> str:
    """Array of one or two integers out of ``[1, 2]``, ``["1", "2"]``, ``{"from": 1, "to": 2}``, ``"1-2"``; what is no 32-bit integer is left out, nothing usable gives null."""
    text = f"CAST(m['{name}'] AS string)"
    numbers = f"transform(regexp_extract_all({text}, '([0-9]+)', 1), x -> try_cast(x AS int))"
    numbers = f"filter({numbers}, x -> x IS NOT NULL)"
    obj = f"filter(array(try_cast(try_variant_get(m['{name}'], '$.from', 'string') AS int), try_cast(try_variant_get(m['{name}'], '$.to', 'string') AS int)), x -> x IS NOT NULL)"
    obj = f"nullif({obj}, CAST(array() AS array<int>))"
    return f"CASE WHEN schema_of_variant(m['{name}']) LIKE 'OBJECT%' THEN {obj} ELSE nullif({numbers}, CAST(array() AS array<int>)) END AS {name}"


def unified_points(raw: DataFrame) -> DataFrame:
    """One consistent payload table of all feeds.

    ``feed, file_no, line_no, file_path, file_mtime, chunk_index, chunks_total, chunk_text, version, page_range,
    line_range, extra`` — one row per whole line (repeated lines of a file once).  Values are found under the file's own
    name or that of the file before (late layouts), cast to the table's type; what can't be cast or is missing is null.
    Fields beyond the payload schema go to ``extra``, a JSON object by their first name.
    """
    lines = parse_lines(raw)
    steps = _steps_of(lines).where("change = 'route'")
    entries = F.collect_list(F.struct("field", "detail"))
    routes = steps.groupBy("feed", "file_no").agg(
        F.map_from_entries(entries).alias("own"), F.map_from_entries(F.collect_list(F.struct("detail", "field"))).alias("name")
    )
    order = Window.partitionBy("feed").orderBy("file_no")
    routes = routes.withColumns({f"prior_{c}": F.coalesce(F.lag(c).over(order), F.expr("CAST(map() AS map<string, string>)")) for c in ("own", "name")})
    fields = ("file_path", "file_mtime", "chunk_index", "chunks_total", "chunk_text", "version", "page_range", "line_range")
    known = ", ".join(f"'{f}'" for f in fields)
    some = lambda x: f"IF(is_variant_null({x}), NULL, {x})"
    pick = lambda f: f"coalesce({', '.join(some(f'vm[{n}]') for n in (f"name['{f}']", f"prior_name['{f}']", f"'{f}'"))})"
    # of the fields beyond the payload schema, by their first names, each once
    more = (
        "filter(transform(map_entries(vm), x -> named_struct('key', coalesce(own[x.key], prior_own[x.key], x.key), 'value', x.value)), "
        f"x -> x.key NOT IN ({known}) AND NOT is_variant_null(x.value))"
    )
    laid = (
        lines.join(routes, ["feed", "file_no"], "left")
        .selectExpr("feed", "file_no", "line_no", "CAST(v AS map<string, variant>) AS vm", "own", "prior_own", "name", "prior_name")
        .selectExpr("feed", "file_no", "line_no", "map(" + ", ".join(f"'{f}', {pick(f)}" for f in fields) + ") AS m", f"{more} AS more")
        .selectExpr("feed", "file_no", "line_no", "m", "map_from_entries(filter(more, (x, i) -> array_position(transform(more, y -> y.key), x.key) = i + 1)) AS more")
    )
    iso = "unix_micros(try_to_timestamp(CAST(m['file_mtime'] AS string))) / 1e6"
    version = (
        "CASE WHEN schema_of_variant(m['version']) LIKE 'OBJECT%' THEN concat('v', try_variant_get(m['version'], '$.major', 'string'), '.', "
        "try_variant_get(m['version'], '$.minor', 'string'), '.', try_variant_get(m['version'], '$.patch', 'string')) ELSE CAST(m['version'] AS string) END"
    )
    return laid.selectExpr(
        "feed", "file_no", "line_no", "CAST(m['file_path'] AS string) AS file_path",
        f"coalesce(try_cast(CAST(m['file_mtime'] AS string) AS double), {iso}) AS file_mtime",
        "try_cast(CAST(m['chunk_index'] AS string) AS int) AS chunk_index", "try_cast(CAST(m['chunks_total'] AS string) AS int) AS chunks_total",
        "CAST(m['chunk_text'] AS string) AS chunk_text", f"{version} AS version", _range("page_range"), _range("line_range"),
        "to_json(more) AS extra",
    )
