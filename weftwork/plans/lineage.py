"""Recipe documents as tables, and lineage over them.

Documents come from `sources.files.recipe_scan` (or any table with the columns recipe, path,
mapping_dir, layer, document). Everything but the recursive expression trees is
read with one declared JSON schema; a tree is flattened to one row a node
inside the task that holds its field.
"""

from __future__ import annotations

import gc
import json
import re
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructField, StructType

from weftwork.plans.graph import Gathered
from weftwork.session import stage
from weftwork.sources.files import TYPE_ALIASES

_FIELDS = "array<struct<name:string,dataType:string,transformation:string>>"
_GROUPS = "array<struct<name:string,filterCondition:string,default:boolean,fields:array<struct<name:string>>>>"
_TARGET = (f"struct<name:string,type:string,fields:{_FIELDS},weststone:{_FIELDS},groups:{_GROUPS},greencliff:{_GROUPS},"
           "normalizedFields:array<struct<name:string,refSource:array<string>>>,selectDistinct:boolean,"
           "groupByFields:array<string>,javaCode:string,procedureName:string,returnField:string>")
_SOURCE = ("struct<name:string,type:string,group:string,joinerTables:array<string>,joinerType:string,joinerCondition:string,"
           "unionTables:array<struct<name:string,fieldMapping:array<struct<origin:string,union:string>>>>>")
_DOCUMENT = (f"struct<steps:array<struct<target:{_TARGET},sources:array<{_SOURCE}>>>,"
             "table:struct<targetTableNames:array<string>,sourceTableNames:array<string>>>")

# Kinds of step targets and of step sources.
TARGET_KINDS = ["table", "unionInput", "sourceQualifier", "filter", "joinerInput",
                "aggregator", "router", "normalizer", "java", "storedProcedure"]
SOURCE_KINDS = ["table", "union", "sourceQualifier", "filter", "joiner",
                "aggregator", "router", "normalizer", "java", "storedProcedure"]
# Source kinds that can change the number of rows; table and java cannot be told.
ACTIVE = {"sourceQualifier": True, "filter": True, "joiner": True, "aggregator": True, "router": True,
          "union": True, "normalizer": True, "storedProcedure": False}


def canonical(kind: Column) -> Column:
    aliases = F.create_map(*[F.lit(x) for pair in TYPE_ALIASES.items() for x in pair])
    return F.coalesce(F.try_element_at(aliases, F.coalesce(kind, F.lit(""))), kind)


_NAMED = ("steps.target.name", "steps.target.type")
_SOURCED = ("steps.sources.name", "steps.sources.type")
_CORRUPT = "_corrupt"


def _only(kind: DataType, wanted: Sequence[str], at: str = "") -> DataType:
    """The type with only the parts in ``wanted`` (dotted paths), whole below each of them."""
    if isinstance(kind, ArrayType):
        return ArrayType(_only(kind.elementType, wanted, at), kind.containsNull)
    if not isinstance(kind, StructType) or at in wanted:
        return kind
    below = [(f, f"{at}.{f.name}" if at else f.name) for f in kind.fields]
    return StructType([StructField(f.name, _only(f.dataType, wanted, p)) for f, p in below if any(w == p or w.startswith(f"{p}.") for w in wanted)])


def parsed(docs: DataFrame, parts: Sequence[str] | None = None) -> DataFrame:
    """(recipe, doc) with the document as a struct, or these ``parts`` of it; a part of the wrong shape reads as NULL.

    What is not wanted is skipped by the reader, trees foremost, whose text it would spell anew. A document that it cannot read
    through is parsed whole, so its parts are the same whichever are wanted.
    """
    if parts is None:
        return docs.select("recipe", F.from_json("document", _DOCUMENT).alias("doc"))
    shape = _only(DataType.fromDDL(_DOCUMENT), parts).add(_CORRUPT, "string")
    read = lambda c: F.from_json(c, shape, {"columnNameOfCorruptRecord": _CORRUPT})
    narrow = docs.select("recipe", "document", read("document").alias("doc"))
    whole = read(F.to_json(F.from_json("document", _DOCUMENT)))
    return narrow.select("recipe", F.when(F.col(f"doc.{_CORRUPT}").isNull(), F.col("doc")).otherwise(whole).alias("doc"))


def each(df: DataFrame, keep: list, array: str | Column, pos: str, item: str) -> DataFrame:
    """Rows of an array with their position.

    A plain explode would infer a filter on the array below it and so parse the
    document two more times; the outer form with a filter above parses once.
    """
    return df.select(*keep, F.posexplode_outer(array).alias(pos, item)).filter(F.col(pos).isNotNull())


def steps(docs: DataFrame, parts: Sequence[str] | None = None) -> DataFrame:
    """(recipe, step_idx, name, type, kind, target, sources); of target and sources only these ``parts``, if given, no sources if none of theirs."""
    sourced = parts is None or any(p.startswith("steps.sources") for p in parts)
    wanted = None if parts is None else [*parts, *_NAMED, *(_SOURCED if sourced else ())]
    s = each(parsed(docs, wanted), ["recipe"], "doc.steps", "step_idx", "s")
    return s.select("recipe", "step_idx", F.col("s.target.name").alias("name"), F.col("s.target.type").alias("type"),
                    canonical(F.col("s.target.type")).alias("kind"), F.col("s.target").alias("target"),
                    *([F.col("s.sources").alias("sources")] if sourced else []))


def step_sources(step: DataFrame, *more: str, outer: bool = False) -> DataFrame:
    """(recipe, step_idx, step, target_kind, src_idx, name, type, kind, source), and ``more`` columns of the step; ``outer``: also steps without sources."""
    rows = step.select("recipe", "step_idx", F.col("name").alias("step"), F.col("kind").alias("target_kind"), *more,
                       F.posexplode_outer("sources").alias("src_idx", "source"))
    return ((rows if outer else rows.filter(F.col("src_idx").isNotNull()))
            .select("recipe", "step_idx", "step", "target_kind", "src_idx", F.col("source.name").alias("name"),
                    F.col("source.type").alias("type"), canonical(F.col("source.type")).alias("kind"), "source", *more))


def fields(step: DataFrame) -> DataFrame:
    """(recipe, step_idx, step, field_idx, name, data_type, transformation), of the last three those that the steps were parsed with."""
    both = F.coalesce("target.fields", "target.weststone")
    parts = step.schema["target"].dataType["fields"].dataType.elementType.names
    own = {"name": "name", "dataType": "data_type", "transformation": "transformation"}
    return (each(step, ["recipe", "step_idx", F.col("name").alias("step")], both, "field_idx", "f")
            .select("recipe", "step_idx", "step", "field_idx", *[F.col(f"f.{p}").alias(n) for p, n in own.items() if p in parts]))


def declared(docs: DataFrame) -> DataFrame:
    """(recipe, table_name, role, pos) of the tables a recipe declares."""
    doc = parsed(docs, ["table"])
    role = lambda column, name: F.transform(F.coalesce(F.col(f"doc.table.{column}"), F.array().cast("array<string>")), lambda x, i: F.struct(
        x.alias("table_name"), F.lit(name).alias("role"), i.alias("pos")))
    both = F.concat(role("targetTableNames", "target"), role("sourceTableNames", "source"))
    return each(doc, ["recipe"], both, "_i", "t").select("recipe", "t.table_name", "t.role", "t.pos")


_NODE_SCHEMA = ("recipe string, step_idx int, step string, field_idx int, field string, path string, depth int, "
                "kind string, name string, source string, value string, output_field string, condition string, "
                "match_policy string, bind_names array<string>, parent string, param_idx int, siblings int")


def _load(text: str):
    """The tree in a text, or None where a document holds something else in its place."""
    try:
        return json.loads(text)
    except ValueError:
        return None
    except RecursionError:
        return _load_deep(text)


_SPACE = re.compile(r"[ \t\n\r]*")


def _load_deep(text: str):
    """``_load`` for trees of any depth: objects and arrays that are open lie on a list, not on the call stack."""
    scan, open_, at, value, key, before = json.JSONDecoder().scan_once, [], 0, None, None, ""
    try:
        while True:
            at = _SPACE.match(text, at).end()
            c, done = text[at], True
            if c in "{[":
                open_.append((c, {} if c == "{" else [], key))
                key, at, done = None, at + 1, False
            elif c in "}]":
                kind, value, key_ = open_.pop()
                if kind + c not in ("{}", "[]") or before == "," or key is not None:
                    return None
                key, at = key_, at + 1
            elif c == ",":
                at, done = at + 1, False
            else:
                value, at = scan(text, at)
                after = _SPACE.match(text, at).end()
                if open_ and open_[-1][0] == "{" and key is None:
                    if text[after] != ":":
                        return None
                    key, at, done = value, after + 1, False
            before = c
            if done:
                if not open_:
                    return value if not text[at:].strip() else None
                kind, holder, _ = open_[-1]
                if kind == "{":
                    holder[key] = value
                    key = None
                else:
                    holder.append(value)
    except (ValueError, StopIteration, IndexError, TypeError):
        return None


def _plain(value) -> str | None:
    """A JSON value as text: a string as it is, anything else as JSON spells it."""
    return value if value is None or isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def _unwrap(node):
    """A parameter that is itself a field stands for its own transformation."""
    return (node.get("transformation"), ".transformation") if isinstance(node, dict) and "transformation" in node else (node, "")


def _tree(text: str, scan: Callable):
    """``_load`` without its overhead where the text is one plain value from its first character to its last."""
    try:
        tree, end = scan(text, 0)
        return tree if end == len(text) else _load(text)
    except (ValueError, StopIteration, RecursionError):
        return _load(text)


def _tree_rows(tree, path: str, rows: list) -> None:
    """Add the nodes of one tree to ``rows``, depth first."""
    todo = [(tree, path, 0, None, None, None)]
    while todo:
        node, where, depth, parent, idx, siblings = todo.pop()
        if not isinstance(node, dict):
            continue
        name, source, value, params = node.get("name"), node.get("source"), node.get("value"), node.get("parameters")
        literal = value is not None
        if not (name is None or isinstance(name, str)):
            name = _plain(name)
        if not (source is None or isinstance(source, str)):
            source = _plain(source)
        if literal and not isinstance(value, str):
            value = _plain(value)
        if len(node) == 1 and params is None and (source or literal):  # a leaf with nothing else
            rows.append((where, depth, "ref" if source else "literal", None, source, value, None, None, None, [], parent, idx, siblings))
            continue
        params = params if isinstance(params, list) else []
        kind = "lookup" if "outputField" in node else "call" if name else "ref" if source else "literal" if literal else "empty"
        names = [_plain(p["name"]) for p in params if isinstance(p, dict) and p.get("name")]
        rows.append((where, depth, kind, name, source, value, _plain(node.get("outputField")), _plain(node.get("condition")),
                     _plain(node.get("matchPolicy")), names, parent, idx, siblings))
        for i in range(len(params) - 1, -1, -1):
            inner, suffix = _unwrap(params[i])
            todo.append((inner, f"{where}.parameters[{i}]{suffix}", depth + 1, name, i, len(params)))


_NODE_COLUMNS = [("path", pa.string()), ("depth", pa.int32()), ("kind", pa.string()), ("name", pa.string()), ("source", pa.string()),
                 ("value", pa.string()), ("output_field", pa.string()), ("condition", pa.string()), ("match_policy", pa.string()),
                 ("bind_names", pa.list_(pa.string())), ("parent", pa.string()), ("param_idx", pa.int32()), ("siblings", pa.int32())]


# The text of a tree that is one reference and nothing else, spelled plainly.
_LEAF = r'^\{"source":"[^"\\\x00-\x1f]+"\}$'
_REF_COLUMNS = ("path", "source")
REFS, LOOKUPS = "refs", "lookups"  # nodes that `field_refs` reads, and those that are lookups


def _tree_refs(tree, path: str, rows: list) -> None:
    """(path, source) of the nodes of one tree whose source holds a dot."""
    todo = [(tree, path)]
    while todo:
        node, where = todo.pop()
        if not isinstance(node, dict):
            continue
        source, params = node.get("source"), node.get("parameters")
        if source is not None:
            source = _plain(source)
            if "." in source:
                rows.append((where, source))
        if isinstance(params, list):
            for i, param in enumerate(params):
                inner, suffix = _unwrap(param)
                if isinstance(inner, dict) and ("source" in inner or "parameters" in inner):
                    todo.append((inner, f"{where}.parameters[{i}]{suffix}"))


def _leaves(batch: pa.RecordBatch, columns: list[str], only: str | None) -> pa.RecordBatch:
    """Rows of the fields whose trees are one reference, built by Arrow."""
    text = lambda n: pc.cast(batch.column(batch.schema.get_field_index(n)), pa.string())
    whole = text("transformation")
    source = pc.utf8_slice_codeunits(whole, len('{"source":"'), -2)
    path = pc.binary_join_element_wise("$.steps[", text("step_idx"), "].target.fields[", text("field_idx"), "].transformation", "")
    n = batch.num_rows
    known = {"path": path, "source": source, "kind": pa.repeat("ref", n), "depth": pa.repeat(pa.scalar(0, pa.int32()), n), "bind_names": pa.array([[]] * n, pa.list_(pa.string()))}
    made = {c: known[c] if c in known else pa.nulls(n, kind) for c, kind in _NODE_COLUMNS if c in columns}
    own = batch.drop_columns(["transformation"])
    out = pa.RecordBatch.from_arrays([*own.columns, *made.values()], [*own.schema.names, *made])
    return out.filter(pc.match_substring(source, ".")) if only == REFS else out


def _flatten(batches: Iterator[pa.RecordBatch], columns: list[str], only: str | None) -> Iterator[pa.RecordBatch]:
    """Rows of all trees of a batch, with these columns of a node; the columns of a field are repeated by Arrow, not rebuilt in Python."""
    scan = json.JSONDecoder().scan_once
    refs = only == REFS and set(columns) <= set(_REF_COLUMNS)
    walk, kinds = (_tree_refs, [x for x in _NODE_COLUMNS if x[0] in _REF_COLUMNS]) if refs else (_tree_rows, _NODE_COLUMNS)
    at = {n: i for i, (n, _) in enumerate(kinds)}
    wanted = {REFS: lambda r: r[at["source"]] and "." in r[at["source"]], LOOKUPS: lambda r: r[at["kind"]] == "lookup"}.get(None if refs else only)
    for whole in batches:
        text = whole.column(whole.schema.get_field_index("transformation"))
        if only == LOOKUPS:  # a lookup has this key, unless letters of it are escaped
            batch = whole.filter(pc.match_substring_regex(text, r"outputField|\\"))
        else:
            leaf = pc.match_substring_regex(text, _LEAF)
            yield _leaves(whole.filter(leaf), columns, only)
            batch = whole.filter(pc.invert(leaf))
        rows, owner = [], []
        fields = [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("step_idx", "field_idx", "transformation")]
        gc.disable()  # trees and rows hold no cycles, and each collection would walk all rows so far
        try:
            for i, (step, number, text) in enumerate(zip(*fields)):
                before = len(rows)
                walk(_tree(text, scan), f"$.steps[{step}].target.fields[{number}].transformation", rows)
                if wanted:
                    rows[before:] = filter(wanted, rows[before:])
                owner.extend([i] * (len(rows) - before))
        finally:
            gc.enable()
        if not rows:
            continue
        of_field = batch.drop_columns(["transformation"]).take(pa.array(owner, pa.int32()))
        arrays = {n: pa.array(values, kind) for values, (n, kind) in zip(zip(*rows), kinds) if n in columns}
        yield pa.RecordBatch.from_arrays([*of_field.columns, *arrays.values()], [*of_field.schema.names, *arrays])


def expr_nodes(field: DataFrame, columns: Sequence[str] | None = None, only: str | None = None) -> DataFrame:
    """One row a node of every field's expression tree, with the columns of its field and all its own, or those named in ``columns``.

    ``only``: REFS leaves out nodes whose source holds no dot, which `field_refs` would drop, LOOKUPS all but lookups.
    """
    kept = [n for n, _ in _NODE_COLUMNS if columns is None or n in columns]
    schema = StructType([f for f in StructType.fromDDL(_NODE_SCHEMA) if f.name in kept or f.name not in dict(_NODE_COLUMNS)])
    trees = field.filter(F.col("transformation").startswith("{"))
    return trees.select("recipe", "step_idx", "step", "field_idx", F.col("name").alias("field"), "transformation").mapInArrow(
        lambda batches: _flatten(batches, kept, only), schema)


def _render(tree) -> str:
    """The tree as a formula; what is still to be written lies on a list, so any depth will do."""
    out, todo = [], [(tree, "")]
    while todo:
        node, written = todo.pop()
        if written:
            out.append(written)
        elif isinstance(node, dict) and node.get("name"):
            params = node.get("parameters") if isinstance(node.get("parameters"), list) else []
            out.append(f"{_plain(node['name'])}(")
            todo.append((None, ")"))
            for i, p in reversed(list(enumerate(params))):
                todo.append((_unwrap(p)[0], ""))
                if i:
                    todo.append((None, ", "))
        elif isinstance(node, dict):
            leaf = node.get("source") or node.get("value")
            out.append("" if leaf is None else _plain(leaf))
    return "".join(out)


def formula_archive(field: DataFrame) -> DataFrame:
    """(recipe, step_idx, step, field, formula) of each field computed by a call."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            trees = [_load(t) for t in batch.column(batch.schema.get_field_index("transformation")).to_pylist()]
            calls = [i for i, tree in enumerate(trees) if isinstance(tree, dict) and tree.get("name")]
            kept = batch.drop_columns(["transformation"]).take(pa.array(calls, pa.int32()))
            yield kept.append_column("formula", pa.array([_render(trees[i]) for i in calls], pa.string()))

    maybe = field.filter(F.col("transformation").startswith("{") & F.col("transformation").contains('"name"'))
    return maybe.select("recipe", "step_idx", "step", F.col("name").alias("field"), "transformation").mapInArrow(
        run, "recipe string, step_idx int, step string, field string, formula string")


def field_refs(nodes: DataFrame) -> DataFrame:
    """All ``T.F`` references: (recipe, to_step, to_field, table, field, path); split at the first dot."""
    dot = F.instr("source", ".")
    return (nodes.filter(dot > 0)
            .select("recipe", "step_idx", F.col("step").alias("to_step"), F.col("field").alias("to_field"),
                    F.substring_index("source", ".", 1).alias("table"), F.expr("substring(source, instr(source, '.') + 1)").alias("ref_field"),
                    "path")
            .filter((F.trim("table") != "") & (F.trim("ref_field") != "")))


def call_sites(nodes: DataFrame) -> DataFrame:
    """Every node with a name: the archive of calls."""
    return nodes.filter(F.trim(F.coalesce("name", F.lit(""))) != "").select(
        "recipe", "step_idx", "step", "field", "path", "name", F.col("output_field").isNotNull().alias("is_lookup"))


def call_counts(sites: DataFrame) -> DataFrame:
    """Uses of each function, and the recipes and fields that use it."""
    return sites.groupBy("name").agg(F.count("*").alias("calls"), F.count_distinct("recipe").alias("recipes"))


def usage(docs: DataFrame, ddl: DataFrame) -> DataFrame:
    """Distinct (table, role, recipe) with role source, target or ddl; a DDL belongs to the recipes of its directory."""
    used = declared(docs).join(docs.select("recipe", "path").hint("shuffle_hash"), "recipe").select(F.col("table_name").alias("table"), "role", "path")
    owns = ddl.select("dir", "table").distinct().join(docs.select(F.col("mapping_dir").alias("dir"), "path"), "dir")
    return used.unionByName(owns.select("table", F.lit("ddl").alias("role"), "path")).distinct()


def usage_counts(used: DataFrame) -> DataFrame:
    counts = {r: F.count_if(F.col("role") == r).alias(f"as_{r}") for r in ("source", "target", "ddl")}
    return used.groupBy("table").agg(*counts.values())


def schema_variants(ddl: DataFrame) -> DataFrame:
    """One row a (table, distinct column set, directory); the order of columns does not matter."""
    sets = ddl.groupBy("table", "dir").agg(F.array_sort(F.collect_set(F.concat_ws(" ", "column", "type"))).alias("c"))
    return sets.select("table", F.array_join("c", ", ").alias("columns"), "dir")


def variant_summary(variants: DataFrame) -> DataFrame:
    return variants.groupBy("table", "columns").agg(F.count("*").alias("n_dirs"), F.min("dir").alias("first_dir"))


def table_columns(ddl: DataFrame) -> DataFrame:
    """Union of the columns of every copy of a table."""
    return ddl.select("table", "column").distinct()


def corpus_summary(files: DataFrame) -> DataFrame:
    """One row over corpus-relative ``path``: XML, recipe and DDL files, directories, sorted layers (at most one a top directory kind)."""
    name = F.element_at(F.split("path", "/"), -1)
    recipe = name.rlike(r"^_ETL_.*\.json$")
    return files.agg(
        F.count_if(F.lower(name).endswith(".xml")).alias("xml_files"), F.count_if(recipe).alias("recipe_files"),
        F.count_if(name.endswith(".json") & ~name.startswith("_")).alias("ddl_files"),
        F.count_distinct(F.regexp_replace("path", r"/[^/]*$", "")).alias("dirs"),
        F.array_join(F.array_sort(F.collect_set(F.when(recipe, F.split("path", "/")[0]))), ",").alias("layers"))


def impact(refs: DataFrame, name: str | None = None) -> DataFrame:
    """(table, ref_field?) impact: number of distinct fields that reference a step or table."""
    hit = refs if name is None else refs.filter(F.lower("table") == name.lower())
    return hit.groupBy(F.lower("table").alias("table")).agg(
        F.count_distinct("recipe", "step_idx", "to_field").alias("fields"), F.count_distinct("recipe").alias("recipes"))


def kind_pairings(sources: DataFrame) -> DataFrame:
    """Observed (source kind, target kind) and how often."""
    return sources.groupBy(F.col("kind").alias("source_kind"), "target_kind").agg(F.count("*").alias("n"))


def active_of(kind: Column) -> Column:
    return F.when(kind.isin([k for k, a in ACTIVE.items() if a]), True).when(
        kind.isin([k for k, a in ACTIVE.items() if not a]), False)


def fan_in_verdict(pairings: DataFrame) -> DataFrame:
    """Verdict for joining ``candidate`` to the kinds that feed an input already.

    ``pairings`` has (id, candidate, existing), one row an existing kind and ``existing`` NULL
    when the input is free. Unknown kinds warn first; an active step must be alone.
    """
    grouped = pairings.groupBy("id", "candidate").agg(
        F.count("existing").alias("n"),
        F.bool_or(F.col("existing").isNotNull() & active_of(F.col("existing")).isNull()).alias("unknown"),
        F.bool_or(F.coalesce(active_of(F.col("existing")), F.lit(False))).alias("has_active"))
    mine = active_of(F.col("candidate"))
    return grouped.select("id", "candidate", F.when(mine.isNull() | F.col("unknown"), "warn")
                          .when((mine & (F.col("n") > 0)) | (~mine & F.col("has_active")), "block")
                          .otherwise("ok").alias("verdict"))


# A quoted text, a comment to the end of the line or between marks, or (the group) a name.
_NAMES = r"'(?:[^']|'')*'|(?:--|//)[^\n]*|(?s:/\*.*?\*/)|([\p{L}\p{N}\p{M}_$#]+)"


MAPPING_ROWS = 4096  # connectors, ports and instances of a mapping that one task walks at most; larger mappings are walked by joins
_PARTS = "mapping string, kind int, a string, b string, c string, d string, words array<string>"
_CONNECTOR, _PORT, _INSTANCE = range(3)  # kinds of rows of a mapping
_ORIGINS = "mapping string, target_instance string, target_field string, source_instance string, source_field string"


def connector_lineage(connectors: DataFrame, ports: DataFrame, instances: DataFrame) -> DataFrame:
    """(mapping, target_instance, target_field, source_instance, source_field): origins of every target field.

    A field comes from what its connectors bring in; a computed port from the ports its
    expression names, found by looking up the names in the expression, not by pairing ports. Names may hold letters of any
    alphabet, digits, ``_``, ``$`` and ``#``; those in quoted texts and comments are not names.

    A mapping's rows meet in one task, which walks them back at once, so they are shuffled once. A mapping of more than MAPPING_ROWS rows is only
    named there, and walked by joins over all tasks.
    """
    words = F.array_distinct(F.regexp_extract_all("expression", F.lit(_NAMES), F.lit(1)))
    nothing, none = F.lit(None).cast("string"), F.lit(None).cast("array<string>")
    rows = (connectors.select("mapping", F.lit(_CONNECTOR).alias("kind"), F.col("from_instance").alias("a"), F.col("from_field").alias("b"),
                              F.col("to_instance").alias("c"), F.col("to_field").alias("d"), none.alias("words"))
            .union(ports.select("mapping", F.lit(_PORT), "transformation", "name", nothing, nothing, words))
            .union(instances.select("mapping", F.lit(_INSTANCE), "name", "transformation", F.when(F.upper("type") == "TARGET", "T"), nothing, none)))
    # Without a mapping a target's instance is not found, so such rows have no origins.
    placed = rows.filter(F.col("mapping").isNotNull()).repartition("mapping").sortWithinPartitions("mapping")
    limit = MAPPING_ROWS
    found = stage(placed.mapInArrow(lambda batches: _origins_of(batches, limit), _ORIGINS + ", large boolean"), "origins", "zstd")
    large = found.filter("large").select("mapping")
    origins = found.filter("NOT large").drop("large")
    if large.isEmpty():
        return origins
    of_large = [df.join(large, "mapping", "left_semi") for df in (connectors, ports, instances)]
    return origins.unionByName(_origins_by_joins(*of_large))


def _origins_of(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Origins of the mappings in rows sorted by mapping; one of more than ``limit`` rows is passed on as large."""
    out, mapping, rows, count = [], None, [], 0

    def closed():
        if count > limit:
            out.append((mapping, None, None, None, None, True))
        elif count:
            out.extend((mapping, *target, *source, False) for target, source in _walked(rows))

    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for name, row in zip(columns[0], zip(*columns[1:])):
            if name != mapping:
                closed()
                mapping, rows, count = name, [], 0
            count += 1
            if count <= limit:
                rows.append(row)
            elif rows:
                rows = []
        while out:
            yield _origin_batch(out[:_ORIGINS_A_BATCH])
            del out[:_ORIGINS_A_BATCH]
    closed()
    while out:
        yield _origin_batch(out[:_ORIGINS_A_BATCH])
        del out[:_ORIGINS_A_BATCH]


_ORIGINS_A_BATCH = 1 << 16


def _origin_batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [n.split()[0] for n in _ORIGINS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.bool_() if i == len(names) else pa.string()) for i, c in enumerate(zip(*rows))], names=[*names, "large"])


def _walked(rows: list[tuple]) -> Iterator[tuple[tuple, tuple]]:
    """(target, origin) of one mapping, each an (instance, field), from its rows (kind, a, b, c, d, words)."""
    up, ports, instances, starts = {}, {}, [], {}
    for kind, a, b, c, d, words in rows:
        if kind == _CONNECTOR:
            up.setdefault((c, d), {})[a, b] = None
            starts.setdefault(c, {})[c, d] = None
        elif kind == _PORT:
            ports.setdefault(a, []).append((b, words))
        else:
            instances.append((a, b, c))
    targets = {name for name, _, kind in instances if kind and name is not None}
    names: dict[str, set] = {}  # ports by instance
    for name, transformation, _ in instances:
        if name is not None and transformation is not None:
            names.setdefault(name, set()).update(port for port, _ in ports.get(transformation, ()))
    for name, transformation, _ in instances:
        if name is not None and transformation is not None:
            for port, words in ports.get(transformation, ()):
                for word in words or ():
                    if port is not None and word != port and word in names[name]:
                        up.setdefault((name, port), {})[name, word] = None
    for target in targets:
        for start in starts.get(target, ()):
            seen, todo = {start}, [start]
            while todo:
                for at in up[todo.pop()]:
                    if at not in seen:
                        seen.add(at)
                        if at in up:
                            todo.append(at)
                        else:
                            yield start, at


def _origins_by_joins(connectors: DataFrame, ports: DataFrame, instances: DataFrame) -> DataFrame:
    """The rows of `connector_lineage` over mappings of any size: all targets take a step back in each round."""
    node = lambda i, f: F.concat_ws("\u0001", "mapping", i, f)
    links = connectors.select(node("to_instance", "to_field").alias("src"), node("from_instance", "from_field").alias("dst"))
    placed = ports.join(instances.select("mapping", F.col("name").alias("instance"), "transformation"), ["mapping", "transformation"])
    words = placed.filter(F.col("expression").isNotNull()).select(
        "mapping", "instance", F.col("name").alias("port"),
        F.explode(F.array_distinct(F.regexp_extract_all("expression", F.lit(_NAMES), F.lit(1)))).alias("name"))
    inner = (words.join(placed.select("mapping", "instance", "name"), ["mapping", "instance", "name"])
             .filter(F.col("port") != F.col("name"))
             .select(node("instance", "port").alias("src"), node("instance", "name").alias("dst")))
    # Rounds are written as Parquet, which packs names that share most of their letters; a checkpoint would spell them out.
    up = stage(links.union(inner).distinct(), "up", "zstd")
    inside = up.select(F.col("src").alias("dst")).distinct().withColumn("more", F.lit(True))  # nodes that come from others themselves
    up = stage(up.join(inside, "dst", "left").select("src", "dst", F.coalesce("more", F.lit(False)).alias("more")), "up", "zstd")
    targets = connectors.join(instances.filter(F.upper("type") == "TARGET").select("mapping", F.col("name").alias("to_instance")),
                              ["mapping", "to_instance"], "left_semi")
    start = targets.select(node("to_instance", "to_field").alias("origin_of")).distinct()
    frontier = stage(start.withColumn("at", F.col("origin_of")), "frontier", "zstd")
    seen, ends = frontier, []
    while True:
        met = stage(frontier.join(up, frontier["at"] == up["src"]).select("origin_of", F.col("dst").alias("at"), "more"), "met", "zstd")
        ends.append(met.filter("NOT more").select("origin_of", "at"))  # what ends here needs no look at earlier rounds
        frontier = stage(met.filter("more").select("origin_of", "at").distinct().join(seen, ["origin_of", "at"], "left_anti"), "frontier", "zstd")
        if frontier.isEmpty():
            break
        seen = stage(seen.union(frontier), "seen", "zstd") if len(ends) % Gathered.MERGE_AFTER == 0 else seen.union(frontier)
    ends = reduce(DataFrame.union, ends).distinct().filter("at <> origin_of")
    t, s = F.split("origin_of", "\u0001"), F.split("at", "\u0001")
    return ends.select(t[0].alias("mapping"), t[1].alias("target_instance"), t[2].alias("target_field"),
                       s[1].alias("source_instance"), s[2].alias("source_field"))


def _shared_parts(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two arrays."""
    times = lambda arr, p: F.size(F.filter(arr, lambda x: x == p))
    return F.aggregate(F.array_intersect(a, b), F.lit(0), lambda acc, p: acc + F.least(times(a, p), times(b, p)))


def rename_sources(rows: DataFrame) -> DataFrame:
    """Staging names in lineage rows (mapping, target, source, pos).

    Where the target is a staging table, it becomes ODS and the one source
    sharing most name parts with it (earliest on ties) takes the staging name;
    elsewhere staging sources become ODS ones.
    """
    staging = r"^STG"
    up = rows.withColumns({"target": F.upper("target"), "source": F.upper("source")})
    legacy = F.col("target").rlike(staging)
    parts = lambda c: F.split(c, "_")
    score = _shared_parts(F.slice(parts(F.col("target")), F.lit(2), F.size(parts(F.col("target")))), parts(F.col("source")))
    best = (up.filter(legacy).withColumn("_score", score).groupBy("mapping", "target")
            .agg(F.max_by("source", F.struct("_score", -F.col("pos"))).alias("_best")))
    joined = up.join(best, ["mapping", "target"], "left")
    source = (F.when(legacy & (F.col("source") == F.col("_best")), F.col("target")).when(legacy, F.col("source"))
              .otherwise(F.regexp_replace("source", staging, "ODS")))
    return joined.select("mapping", "pos", F.regexp_replace("target", staging, "ODS").alias("new_target"), source.alias("new_source"))
