"""Schemas that drift between files: rescue-column ingestion and a report of each change.

A record is read against a target schema. What the schema holds and the value fits goes into the typed part; every other field, and every value
that can't be cast, is kept as JSON in `_rescued`. Approved fields are promoted later by replaying the rescued values into typed columns.
Ingesting a file against the schema of the file before it (and that one against its successor's) rescues just what changed between them: fields the
other schema lacks were added or removed, values that don't fit its class are a change of type.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from takeloom.session import NUMBER, canonical, stage

DELIMITERS = (",", ";", "\t", "|")
#: Classes from narrow to wide; integer fits decimal, everything fits text.
CLASSES = ("boolean", "integer", "decimal", "text")
#: SQL types that are read from numbers; columns of other types are text, as it is.
NUMERIC = ("double", "float", "int", "bigint")


def _split(line: str, delimiter: str) -> list[str]:
    if '"' not in line:
        return line.split(delimiter)
    return next(csv.reader([line], delimiter=delimiter), [""])


def header_fields(header: str | None) -> tuple[str, list[str]]:
    """Delimiter and field names of a header line. Names are trimmed and lower-cased, without byte-order mark and quotes; a repeated one gets _2, _3, ..."""
    text = (header or "").replace("\ufeff", "")
    delimiter = max(DELIMITERS, key=text.count)
    names: list[str] = []
    seen: dict[str, int] = {}
    for raw in _split(text.strip(" \r\n"), delimiter) if text.strip() else []:
        name = raw.strip().strip("\"'").strip().lower()
        seen[name] = seen.get(name, 0) + 1
        names.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    return delimiter, names


def read_headers(files: DataFrame) -> DataFrame:
    """files (file_id, series_id, written_at, header) with delimiter and fields, and the ids of the next and the previous file of the series."""

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            parsed = [header_fields(h) for h in pdf["header"]]
            yield pdf.assign(delimiter=[d for d, _ in parsed], fields=[f for _, f in parsed])[["file_id", "series_id", "written_at", "delimiter", "fields"]]

    series = Window.partitionBy("series_id").orderBy("written_at", "file_id")
    parsed = files.select("file_id", "series_id", "written_at", "header").mapInPandas(parse, "file_id long, series_id long, written_at timestamp, delimiter string, fields array<string>")
    return parsed.withColumn("prev_file", F.lag("file_id").over(series)).withColumn("next_file", F.lead("file_id").over(series))


#: What a value is, outer blanks included: nothing, a whole number, a number, true or false.
NOTHING, WHOLE, DECIMAL, TRUTH = r"(?i)^ *(nan)? *$", r"^ *[+-]?\d+ *$", NUMBER.replace("^", "^ *").replace("$", " *$"), r"(?i)^ *(true|false) *$"


#: A quoted value and what follows its closing quote.
_OPENED = r'(?s)^"((?:[^"]++|"")*+)"?(.*)$'


def _cut(record: Column, delimiter: Column) -> Column:
    """The values of a line: cut at the delimiter, quoted ones by a pattern (a doubled quote is one quote, an open one goes on to the end)."""
    quoted = None
    for d in DELIMITERS:
        c = "\\" + d if d == "|" else d
        pattern = f'{c}("(?:[^"]++|"")*+(?:"[^{c}]*|$)|[^{c}]*)'
        raw = F.transform(F.regexp_extract_all(F.concat(F.lit(d), record), F.lit(pattern), 1), lambda x: F.when(x.startswith('"'), F.concat(F.replace(F.regexp_extract(x, _OPENED, 1), F.lit('""'), F.lit('"')), F.regexp_extract(x, _OPENED, 2))).otherwise(x))
        quoted = F.when(delimiter == d, raw) if quoted is None else quoted.when(delimiter == d, raw)
    plain = None
    for d in DELIMITERS:
        parts = F.split(record, "\\" + d if d == "|" else d)
        plain = F.when(delimiter == d, parts) if plain is None else plain.when(delimiter == d, parts)
    return F.when(record.isNull(), F.array().cast("array<string>")).when(record.contains('"'), quoted).otherwise(plain)


def value_class(raw: Column) -> Column:
    """0 boolean, 1 integer, 2 decimal, 3 text; NULL for no value."""
    return F.when(raw.rlike(DECIMAL), F.when(raw.rlike(WHOLE), 1).otherwise(2)).when(raw.isNull() | raw.rlike(NOTHING), None).when(raw.rlike(TRUTH), 0).otherwise(3)


def read_records(records: DataFrame, headers: DataFrame) -> DataFrame:
    """One row per line of a file (file_id, series_id, line_no, fields, raw, codes, extra): the header's fields, the values under them and the classes of those.

    A line delivered twice is kept once (its lowest record_id). Values beyond the header go to `extra`; a line that ends early has fewer values than fields. Each value is classed
    here, once, for all that follows.
    """
    once = records.select("record_id", "file_id", "line_no", "record").groupBy("file_id", "line_no").agg(F.min_by("record", "record_id").alias("record"))
    joined = once.join(headers.select("file_id", "series_id", "delimiter", "fields"), "file_id").withColumn("all", _cut(F.col("record"), F.col("delimiter")))
    own = joined.withColumn("raw", F.slice("all", 1, F.size("fields")))
    return own.select("file_id", "series_id", "line_no", "fields", "raw", F.transform("raw", value_class).alias("codes"), F.expr("slice(all, size(fields) + 1, greatest(size(all) - size(fields), 0))").alias("extra"))


def profile(records: DataFrame) -> DataFrame:
    """(file_id, pos, code): the class over all values of each field of each file, fields by their position; NULL if it has no values."""
    per = records.select("file_id", F.posexplode("codes").alias("pos", "c")).groupBy("file_id", "pos").agg(F.min("c").alias("lo"), F.max("c").alias("hi"))
    # booleans mixed with anything else are text
    return per.select("file_id", "pos", F.when((F.col("lo") == 0) & (F.col("hi") > 0), 3).otherwise(F.col("hi")).alias("code"))


def schemas(headers: DataFrame, records: DataFrame) -> DataFrame:
    """(file_id, fields, classes): the schema of each file, classes in the order of the fields, NULL where a field has no values."""
    found = profile(records).groupBy("file_id").agg(F.map_from_entries(F.collect_list(F.struct("pos", "code"))).alias("m"))
    joined = headers.select("file_id", "fields").join(found, "file_id", "left")
    return joined.select("file_id", "fields", F.transform("fields", lambda _, i: F.col("m")[i]).alias("classes"))


def wanted(fields: str, target_fields: Column, target_classes: Column) -> Column:
    """For each of the fields the class that the target schema has for it: 3 where it has none, -1 where it lacks the field."""
    def want(f: Column) -> Column:
        at = F.array_position(target_fields, f).cast("int")
        return F.when(at > 0, F.coalesce(F.get(target_classes, at - 1), F.lit(3))).otherwise(-1)

    return F.transform(fields, want)


def _fits(need: Column, have: Column) -> Column:
    """Whether a value of class `have` (NULL: no value) may stand where `need` is wanted."""
    return have.isNull() | (have == need) | (need == 3) | ((need == 2) & (have == 1))


def ingested(records: DataFrame, want: Column, rescued_only: bool = False) -> DataFrame:
    """records with `kept` (map of the fields whose value fits what is wanted, see wanted()) and `_rescued` (JSON of all others, NULL where there are none).

    rescued_only: only records that have some, and no `kept`.
    """
    rows = records.withColumn("_fit", F.zip_with(F.slice(want, 1, F.size("raw")), "codes", lambda need, have: (need >= 0) & _fits(need, have)))
    fit = F.col("_fit")
    part = lambda good: F.map_from_arrays(*[F.filter(c, lambda _, i: F.get(fit, i) if good else ~F.get(fit, i)) for c in ("fields", "raw")])
    some, lost = F.exists("_fit", lambda f: ~f), F.to_json(part(False), {"ignoreNullFields": "false"})
    if rescued_only:  # before the JSON is made, or it would be made for the test as well
        return rows.where(some).withColumn("_rescued", lost).drop("_fit")
    return rows.withColumn("kept", part(True)).withColumn("_rescued", F.when(some, lost)).drop("_fit")


def rescue(records: DataFrame, schemas: DataFrame) -> DataFrame:
    """Enforce on each file the schema given for it in schemas (file_id, schema map<field, class>).

    Result: the columns of records but for fields, raw and codes, `kept` (map of the fields that the schema has and whose value fits its class) and `_rescued`
    (JSON of all others, NULL where there are none). Nothing is lost: together they hold every entry. A NULL or no value fits every class.
    """
    known = F.coalesce("schema", F.expr("map()").cast("map<string,string>"))
    classes = F.transform(F.map_values(known), lambda c: F.array_position(F.array(*map(F.lit, CLASSES)), c).cast("int") - 1)
    joined = records.join(schemas, "file_id", "left").withColumn("_want", wanted("fields", F.map_keys(known), classes))
    return ingested(joined, F.col("_want")).drop("_want", "schema", "fields", "raw", "codes")


def promote(rescued: DataFrame, approved: dict[str, tuple[str, str]]) -> DataFrame:
    """Replay rescued values into typed columns. approved: column -> (SQL type, a number's or string, and the names under which the field occurs, comma-separated, the first first).

    Each column takes the first of its names that has a castable value, in `kept` or in `_rescued`; what a column took leaves `_rescued`, what
    can't be cast, isn't approved or came second stays there. No value is NULL in its column.
    """
    text = "map<string,string>"
    df = rescued.withColumn("lost", F.coalesce(F.from_json("_rescued", text), F.expr("map()").cast(text)))
    # a field is in one of the two maps; every value is trimmed and read as a number once, columns only pick
    df = df.withColumn("texts", F.map_filter(F.transform_values(F.map_concat(F.coalesce("kept", F.expr("map()").cast(text)), "lost"), lambda _, v: F.trim(v)), lambda _, v: ~F.lower(v).isin("", "nan")))
    df = df.withColumn("numbers", F.transform_values(F.map_filter("texts", lambda _, v: v.rlike(NUMBER)), lambda _, v: v.try_cast("double")))

    # one array of columns for each map, so that the generated code stays small however many columns there are
    kinds = {"numbers": [n for n, (k, _) in approved.items() if k in NUMERIC], "texts": [n for n, (k, _) in approved.items() if k not in NUMERIC]}
    for place, names in kinds.items():
        options = F.array(*[F.array(*map(F.lit, approved[n][1].split(","))) for n in names]) if names else F.array().cast("array<array<string>>")
        found = F.col(place)
        df = df.withColumn(f"{place}_from", F.transform(options, lambda o: F.get(F.filter(o, lambda a: found[a].isNotNull()), 0)))  # noqa: B023
        df = df.withColumn(f"{place}_value", F.transform(f"{place}_from", lambda a: found[a]))  # noqa: B023
    df = df.withColumn("taken", F.array_compact(F.concat("numbers_from", "texts_from")))
    df = df.withColumn("rest", F.map_filter("lost", lambda k, _: ~F.array_contains("taken", k)))
    df = df.withColumn("_rescued", F.when(F.size("rest") > 0, F.to_json("rest", {"ignoreNullFields": "false"})))
    at = {n: F.get(f"{place}_value", i) for place, names in kinds.items() for i, n in enumerate(names)}
    return df.select(*[c for c in rescued.columns if c not in ("kept", "_rescued")], "_rescued", *[at[n].try_cast(k).alias(n) for n, (k, _) in approved.items()])


def schema_changes(files: DataFrame, records: DataFrame) -> DataFrame:
    """Changes from each file of a series to the next: (file_id, field, change, new_field), file_id being the later file's.

    `renamed`: a field only in the earlier file and one only in the later (new_field) have the same value (or none) on every line in both, and there
    is such a line. `added`, `removed`: other fields on one side only. `type`: a field in both whose class differs (boolean, integer, decimal,
    text over all its values); a field without values has no class and changes none. Files tied on written_at follow in order of file_id;
    files without records have the fields of their header. Repeated lines count once. new_field is '' unless renamed.

    Every change comes from the rescue column: each file, header and lines, is ingested against the schemas of its neighbours. Fields the neighbour lacks are rescued
    and so are new (in the later file) or gone (from the earlier one); where two classes differ, a value of one side doesn't fit the other's and is rescued. Rescued
    fields are compared by checksums over the lines both files have, so no two columns are joined value by value.
    """
    headers = stage(read_headers(files), "headers")
    lines = stage(read_records(records, headers), "records")
    schema = stage(schemas(headers, lines), "schemas")
    asks = F.explode(F.array_compact(F.array(
        F.when(F.col("prev_file").isNotNull(), F.struct(F.col("file_id").alias("pair"), F.lit("later").alias("side"), F.col("prev_file").alias("other"))),
        F.when(F.col("next_file").isNotNull(), F.struct(F.col("next_file").alias("pair"), F.lit("earlier").alias("side"), F.col("next_file").alias("other"))),
    ))).alias("ask")
    other = schema.select(F.col("file_id").alias("other"), F.col("fields").alias("other_fields"), "classes")
    own = schema.select("file_id", F.col("classes").alias("own_classes"))
    wants = headers.select("file_id", "fields", asks).select("file_id", "fields", "ask.*").join(other, "other").join(own, "file_id").withColumn("want", wanted("fields", F.col("other_fields"), F.col("classes")))
    # a file whose fields are all known and whose classes fit has nothing that could be rescued, so its lines aren't read again
    may = F.exists(F.arrays_zip("want", "own_classes"), lambda z: (z["want"] < 0) | ~_fits(z["want"], z["own_classes"]))
    unknown = F.filter("fields", lambda f: ~F.array_contains("other_fields", f)).alias("unknown")
    wants = stage(wants.where(may).select("file_id", "pair", "side", unknown, "want"), "wants")
    # a header is a line without values; lines that end early get none for the rest
    whole = lines.select("file_id", "line_no", "fields", F.transform("fields", lambda _, i: F.get("raw", i)).alias("raw"), "codes")
    empty = headers.select("file_id", F.lit(None).cast(whole.schema["line_no"].dataType).alias("line_no"), "fields", F.transform("fields", lambda _: F.lit(None).cast("string")).alias("raw"), F.array().cast("array<int>").alias("codes"))
    found = ingested(whole.unionByName(empty).join(wants, "file_id"), F.col("want"), rescued_only=True)
    found = stage(found.select("pair", "side", "line_no", "unknown", "_rescued"), "rescued")

    lost = found.withColumn("lost", F.from_json("_rescued", "map<string,string>")).select("pair", "side", "line_no", "unknown", "lost")
    fields = lost.select("pair", "side", "unknown", F.explode(F.map_keys("lost")).alias("field")).groupBy("pair", "side", "field").agg(F.max(~F.array_contains("unknown", F.col("field"))).alias("shared"))
    fields = stage(fields, "fields")
    gone, new = (fields.where(~F.col("shared") & (F.col("side") == s)).select("pair", "field") for s in ("earlier", "later"))
    both = gone.select("pair").distinct().join(new.select("pair").distinct(), "pair", "left_semi")
    own = lost.where("line_no is not null").withColumn("lost", F.map_filter("lost", lambda k, _: F.array_contains("unknown", k))).where(F.size("lost") > 0).join(both, "pair", "left_semi")
    later, earlier = (own.where(F.col("side") == s).select("pair", "line_no", F.col("lost").alias(s)) for s in ("later", "earlier"))
    sides = F.explode(F.array(F.struct(F.lit("later").alias("side"), F.col("later").alias("lost")), F.struct(F.lit("earlier").alias("side"), F.col("earlier").alias("lost")))).alias("s")
    values = later.join(earlier, ["pair", "line_no"]).select("pair", "line_no", sides).select("pair", "line_no", "s.side", F.explode("s.lost").alias("field", "raw")).withColumn("v", F.coalesce(canonical("raw"), F.lit("\0")))
    sums = values.groupBy("pair", "side", "field").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("line_no", "v")).alias("x"), F.bit_xor(F.xxhash64("v", "line_no")).alias("y"))
    a, b = (sums.where(F.col("side") == s).select("pair", F.col("field").alias(f"{s}_field"), "n", "x", "y") for s in ("earlier", "later"))
    renamed = stage(a.join(b, ["pair", "n", "x", "y"]).select("pair", "earlier_field", "later_field"), "renamed")

    def rows(df: DataFrame, change: str, field: str = "field", new_field: Column | None = None) -> DataFrame:
        return df.select(F.col("pair").alias("file_id"), F.col(field).alias("field"), F.lit(change).alias("change"), (F.lit("") if new_field is None else new_field).alias("new_field"))

    removed = gone.join(renamed.select("pair", F.col("earlier_field").alias("field")), ["pair", "field"], "left_anti")
    added = new.join(renamed.select("pair", F.col("later_field").alias("field")), ["pair", "field"], "left_anti")
    typed = fields.where("shared").select("pair", "field").distinct()
    return rows(renamed, "renamed", "earlier_field", F.col("later_field")).unionByName(rows(added, "added")).unionByName(rows(removed, "removed")).unionByName(rows(typed, "type"))
