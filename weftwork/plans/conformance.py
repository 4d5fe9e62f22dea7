"""Conformance checks over recipe documents, one query a rule.

A rule maps the document tables to its violations (recipe, path, message). Rules that a single row decides
(a document, step, source, field or expression node) are written as a condition, a path and a message over that row, so
`conformance` evaluates all rules of one grain in one expression; rules across rows are relations of their own.
`conformance` adds one ``pass`` row for each recipe and rule without a violation.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftwork.plans import graph, lineage
from weftwork.session import fresh_path, stage

# Run-time data types, predefined functions, operators, match policies, other call markers.
DATA_TYPES = ["String", "BigDecimal", "Long", "Integer", "LocalDateTime", "Timestamp", "LocalDate", "Boolean"]
PREDEFINED = ["TO_DATE", "TO_CHAR", "LPAD", "RPAD", "SUBSTR", "REPLACECHR", "TO_DECIMAL",
              "REPLACESTR", "CONCAT", "TRUNC", "TO_INTEGER", "LENGTH", "UPPER", "ISNULL", "IS_NUMBER", "INSTR", "IN", "IIF",
              "COUNT", "MAX", "MIN", "GREATEST", "IS_SPACES", "DECODE", "ABS", "ADD_TO_DATE", "LAST_DAY", "SUM", "DATE_DIFF",
              "GET_DATE_PART", "IS_DATE", "CHR", "REG_MATCH", "LEAST", "REG_REPLACE"]
OPERATORS = ["+", "-", "*", "/", "<=", ">=", "<>", "!=", "^=", "=", ">", "<", " AND ", " and ", " OR ", " or ", "||"]
OPERATOR_CALLS = ["EXP_ARITHMETIC", "EXP_COMPARISON", "EXP_LOGICAL"]
MATCH_POLICIES = ["Any", "First", "Last"]
MARKERS = ["SequenceGenerator", "Undefined"]
# Keys a kind must carry, and the rule each missing key reports.
REQUIRED_TARGET_KEYS = [("sourceQualifier", "selectDistinct", "TYP-SQ-001"), ("router", "groups", "TYP-RTR-001"),
                        ("aggregator", "groupByFields", "TYP-AGG-001"), ("normalizer", "normalizedFields", "TYP-NRM-001"),
                        ("java", "javaCode", "TYP-JAVA-001"), ("storedProcedure", "procedureName", "TYP-SP-001")]
REQUIRED_SOURCE_KEYS = [("router", "group", "TYP-RTR-003"), ("joiner", "joinerTables", "TYP-JNR-001"),
                        ("joiner", "joinerType", "TYP-JNR-001"), ("joiner", "joinerCondition", "TYP-JNR-001"),
                        ("union", "unionTables", "TYP-UNI-001")]
WARNINGS = ["REF-002", "REF-003", "REF-006", "FLW-001"]


class Corpus:
    """The document tables, each built when first used.

    ``node_columns`` are the columns of nodes that are wanted, if not all, ``only`` the kind of nodes, ``parts`` those of the steps. Those named in ``keep`` (steps, nodes, declared) are written once as Parquet below the
    shared folder: rules that use them several times, or many rules, then read just the
    columns they need instead of parsing every document again, and a lost executor loses nothing.
    """

    def __init__(self, docs: DataFrame, keep: tuple[str, ...] = (), node_columns: tuple[str, ...] | None = None, only: str | None = None,
                 parts: tuple[str, ...] | None = None):
        self.docs, self._keep, self._node_columns, self._only, self._parts = docs, keep, node_columns, only, parts

    def _shared(self, df: DataFrame, label: str) -> DataFrame:
        if label not in self._keep:
            return df
        path = fresh_path(df.sparkSession, label)
        df.write.parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    @cached_property
    def parsed(self) -> DataFrame:
        return lineage.parsed(self.docs)

    @cached_property
    def steps(self) -> DataFrame:
        return self._shared(lineage.steps(self.docs, self._parts), "steps")

    @cached_property
    def sources(self) -> DataFrame:
        return lineage.step_sources(self.steps)

    @cached_property
    def fields(self) -> DataFrame:
        return lineage.fields(self.steps)

    @cached_property
    def nodes(self) -> DataFrame:
        return self._shared(lineage.expr_nodes(self.fields, self._node_columns, self._only), "nodes")

    @cached_property
    def refs(self) -> DataFrame:
        return lineage.field_refs(self.nodes)

    @cached_property
    def declared(self) -> DataFrame:
        return self._shared(lineage.declared(self.docs), "declared")

    @cached_property
    def names(self) -> DataFrame:
        """Distinct lower-case step names of a recipe."""
        return self.steps.filter(~_blank("name")).select("recipe", F.lower("name").alias("lname")).distinct()

    @cached_property
    def tables(self) -> DataFrame:
        """Distinct lower-case declared source tables."""
        return self.declared.filter(F.col("role") == "source").select("recipe", F.lower("table_name").alias("lname")).distinct()


Rule = Callable[[Corpus], DataFrame]
RowRule = Callable[[], tuple[Column, Column, Column]]
RULES: dict[str, Rule] = {}
ACROSS: dict[str, Rule] = {}  # the part of a rule that needs several rows
ROWS: dict[str, list[tuple[str, RowRule]]] = {"parsed": [], "steps": [], "sources": [], "fields": [], "nodes": []}  # by grain


def rule(rule_id: str) -> Callable[[Rule], Rule]:
    """Register what a rule finds by relating rows."""
    def add(fn: Rule) -> Rule:
        ACROSS[rule_id] = fn
        RULES[rule_id] = lambda c: _whole_rule(c, rule_id)
        return fn
    return add


def row_rule(rule_id: str, grain: str) -> Callable[[RowRule], RowRule]:
    """Register what a rule finds in one row of a grain: (condition, path, message); a rule may have several."""
    def add(fn: RowRule) -> RowRule:
        ROWS[grain].append((rule_id, fn))
        RULES[rule_id] = lambda c: _whole_rule(c, rule_id)
        return fn
    return add


# Grains that one pass decides together: the sources are an array of their step.
PASSES = (("parsed",), ("steps", "sources"), ("fields",), ("nodes",))


def _whole_rule(c: Corpus, rule_id: str) -> DataFrame:
    """(recipe, path, message) of one rule, from all its parts; parts that a row decides share one pass."""
    found = [ACROSS[rule_id](c)] if rule_id in ACROSS else []
    for grains in PASSES:
        parts = [(g, fn) for g in grains for rid, fn in ROWS[g] if rid == rule_id]
        if len(parts) == 1:
            (grain, fn), = parts
            condition, path, message = fn()
            found.append(_found(getattr(c, grain).filter(condition), path, message))
        elif parts:
            found.append(_by_rows(c, grains, rule_id).select("recipe", "path", "message"))
    return reduce(DataFrame.union, found)


def _findings(grain: str, rule_id: str | None) -> Column:
    """What the row rules of a grain, or one of them, find in a row."""
    finding = lambda rid, found: F.when(found[0], F.struct(
        F.lit(rid).alias("rule_id"), found[1].alias("path"), found[2].alias("message")))
    none = F.lit(None).cast("struct<rule_id:string,path:string,message:string>")
    return F.array_compact(F.array(none, *[finding(rid, fn()) for rid, fn in ROWS[grain] if rule_id in (None, rid)]))


def _by_rows(c: Corpus, grains: tuple[str, ...], rule_id: str | None = None) -> DataFrame:
    """(recipe, rule_id, path, message) of the row rules of the grains, all or one, in one pass over their table."""
    if grains == ("steps", "sources"):
        own = c.steps.withColumn("_own", _findings("steps", rule_id))
        rows = lineage.step_sources(own, "_own", outer=True)  # a step without sources has one row
        all_ = F.concat(F.when(F.coalesce("src_idx", F.lit(0)) == 0, F.col("_own")).otherwise(F.array()),
                        F.when(F.col("src_idx").isNotNull(), _findings("sources", rule_id)).otherwise(F.array()))
    else:
        (grain,) = grains
        rows, all_ = getattr(c, grain), _findings(grain, rule_id)
    return (rows.select("recipe", F.explode_outer(all_).alias("f")).filter("f IS NOT NULL")
            .select("recipe", "f.rule_id", "f.path", "f.message"))


def _blank(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.trim(F.coalesce(c, F.lit(""))) == ""


def _step(tail: str = "") -> Column:
    return F.format_string(f"$.steps[%d]{tail}", "step_idx")


def _found(df: DataFrame, path: Column, message: str | Column) -> DataFrame:
    message = F.lit(message) if isinstance(message, str) else message
    return df.select("recipe", path.alias("path"), message.alias("message"))


# --- structure ----------------------------------------------------------------


@row_rule("STR-001", "parsed")
def steps_present():
    return F.coalesce(F.size("doc.steps"), F.lit(0)) <= 0, F.lit("$.steps"), F.lit("steps is empty or no array")


@row_rule("STR-002", "steps")
def target_present():
    return F.col("target").isNull(), _step(".target"), F.lit("step has no target")


@row_rule("STR-003", "steps")
def target_named():
    return F.col("target").isNotNull() & _blank("name"), _step(".target.name"), F.lit("target has no name")


@row_rule("STR-004", "steps")
def target_typed():
    return F.col("target").isNotNull() & _blank("type"), _step(".target.type"), F.lit("target has no type")


@row_rule("STR-005", "steps")
def target_kind_known():
    return (~_blank("type") & ~F.col("kind").isin(lineage.TARGET_KINDS), _step(".target.type"),
            F.concat(F.lit("unknown kind "), "type"))


@row_rule("STR-005", "sources")
def source_kind_known():
    return (~_blank("type") & ~F.col("kind").isin(lineage.SOURCE_KINDS), F.format_string("$.steps[%d].sources[%d].type", "step_idx", "src_idx"),
            F.concat(F.lit("unknown kind "), "type"))


@rule("STR-006")
def names_unique(c: Corpus) -> DataFrame:
    twice = c.steps.filter(~_blank("name")).groupBy("recipe", "name").count().filter("count > 1")
    return _found(twice, F.lit("$.steps"), F.concat(F.lit("step name used more than once: "), "name"))


@rule("STR-007")
def fields_unique(c: Corpus) -> DataFrame:
    twice = c.fields.filter(~_blank("name")).groupBy("recipe", "step_idx", "name").count().filter("count > 1")
    return _found(twice, _step(".target.fields"), F.concat(F.lit("field name used more than once: "), "name"))


def _field_path(tail: str) -> Column:
    return F.format_string(f"$.steps[%d].target.fields[%d]{tail}", "step_idx", "field_idx")


@row_rule("STR-008", "fields")
def type_known():
    return (~F.coalesce(F.col("data_type").isin(DATA_TYPES), F.lit(False)), _field_path(".dataType"),
            F.concat(F.lit("unknown data type "), F.coalesce("data_type", F.lit(""))))


@row_rule("STR-009", "fields")
def field_named():
    return _blank("name"), _field_path(".name"), F.lit("field has no name")


# --- shape of a kind --------------------------------------------------------------


def _missing_key(grain: str, kind: str, key: str) -> RowRule:
    """A required key that a step's target or source lacks."""
    def found():
        holder = "target" if grain == "steps" else "source"
        has = F.coalesce("target.groups", "target.greencliff") if key == "groups" else F.col(f"{holder}.{key}")
        where = _step(f".target.{key}") if grain == "steps" else F.format_string(f"$.steps[%d].sources[%d].{key}", "step_idx", "src_idx")
        return (F.col("kind") == kind) & has.isNull(), where, F.lit(f"required key is missing: {key}")
    return found


for _grain, _keys in (("steps", REQUIRED_TARGET_KEYS), ("sources", REQUIRED_SOURCE_KEYS)):
    for _kind, _key, _id in _keys:
        for _reported in ("TYP-REQ", _id):
            row_rule(_reported, _grain)(_missing_key(_grain, _kind, _key))


@row_rule("TYP-RTR-002", "steps")
def one_default_group():
    defaults = F.size(F.filter(F.coalesce("target.groups", "target.greencliff"), lambda g: F.coalesce(g["default"], F.lit(False))))
    return (F.col("kind") == "router") & (defaults > 1), _step(".target.groups"), F.lit("more than one default group")


@rule("TYP-NRM-002")
def normalized_field_fed(c: Corpus) -> DataFrame:
    f = lineage.each(c.steps.filter(F.col("kind") == "normalizer"), ["recipe", "step_idx"], "target.normalizedFields", "i", "n")
    return _found(f.filter(F.coalesce(F.size("n.refSource"), F.lit(0)) <= 0),
                  F.format_string("$.steps[%d].target.normalizedFields[%d].refSource", "step_idx", "i"), "normalized field has no input")


@row_rule("TYP-JNI-001", "steps")
def joiner_input_name():
    bad = (F.col("kind") == "joinerInput") & ~F.coalesce(F.col("name"), F.lit("")).rlike(r"^.+[.](MASTER|DETAIL)$")
    return bad, _step(".target.name"), F.lit("joiner input is neither .MASTER nor .DETAIL")


@rule("TYP-UNI-001")
def union_mapped(c: Corpus) -> DataFrame:
    tables = c.sources.filter(F.col("kind") == "union").select(
        "recipe", "step_idx", "src_idx", F.posexplode("source.unionTables").alias("k", "t"))
    maps = tables.select("recipe", "step_idx", "src_idx", "k", F.explode("t.fieldMapping").alias("m"))
    return _found(maps.filter(_blank(F.col("m.origin")) | _blank(F.col("m.union"))),
                  F.format_string("$.steps[%d].sources[%d].unionTables[%d].fieldMapping", "step_idx", "src_idx", "k"),
                  "mapping lacks origin or union")


# --- references ---------------------------------------------------------------------


@rule("REF-001")
def table_resolves(c: Corpus) -> DataFrame:
    sources = c.sources.filter(~_blank("name")).select("recipe", F.lower("name").alias("lname"))
    known = c.names.union(sources).union(c.tables).distinct()
    refs = c.refs.withColumn("lname", F.lower("table"))
    return _found(refs.join(known, ["recipe", "lname"], "left_anti"), F.col("path"),
                  F.concat(F.lit("no such step or table: "), "table"))


@rule("REF-002")
def field_resolves(c: Corpus) -> DataFrame:
    """Visible ports: fields, a router's group.port, a normalizer's outputs, a procedure's return field."""
    empty = F.array().cast("array<string>")
    field_names = F.transform(F.coalesce("target.fields", "target.weststone"), lambda f: f["name"])
    group_ports = F.flatten(F.transform(F.coalesce("target.groups", "target.greencliff"), lambda g: F.transform(
        g["fields"], lambda f: F.concat_ws(".", g["name"], f["name"]))))
    outputs = F.transform("target.normalizedFields", lambda n: n["name"])
    ports = F.concat(F.coalesce(field_names, empty),
                     F.when(F.col("kind") == "router", F.coalesce(group_ports, empty)).otherwise(empty),
                     F.when(F.col("kind") == "normalizer", F.coalesce(outputs, empty)).otherwise(empty),
                     F.when((F.col("kind") == "storedProcedure") & ~_blank("target.returnField"),
                            F.array("target.returnField")).otherwise(empty))
    # Only names and ports are kept and moved. References are parsed apart, as keeping their trees would write more than both.
    named = c.steps.filter(~_blank("name") & F.col("recipe").isNotNull()).select("recipe", "step_idx", F.lower("name").alias("lname"), ports.alias("ports"))
    named = stage(named, "ports", "zstd")
    first = named.groupBy("recipe", "lname").agg(F.min("step_idx").alias("step_idx"))
    step = named.join(first, ["recipe", "step_idx"], "left_semi")
    visible = step.select("recipe", "lname", F.explode("ports").alias("p")).select("recipe", "lname", F.lower("p").alias("lport")).distinct()
    refs = (c.refs.select("recipe", "path", "table", "ref_field").withColumns({"lname": F.lower("table"), "lport": F.lower("ref_field")}))
    lost = refs.join(visible, ["recipe", "lname", "lport"], "left_anti").join(first.select("recipe", "lname"), ["recipe", "lname"], "left_semi")
    return _found(lost, F.col("path"), F.concat(F.lit("no such port: "), "table", F.lit("."), "ref_field"))


@rule("REF-003")
def source_resolves(c: Corpus) -> DataFrame:
    sources = c.sources.filter(~_blank("name")).withColumn("lname", F.lower("name"))
    known = c.names.union(c.tables).distinct()
    return _found(sources.join(known, ["recipe", "lname"], "left_anti"),
                  F.format_string("$.steps[%d].sources[%d].name", "step_idx", "src_idx"), F.concat(F.lit("no such source: "), "name"))


@rule("REF-004")
def no_self_reference(c: Corpus) -> DataFrame:
    own = c.refs.filter(~_blank("to_step") & (F.lower("table") == F.lower("to_step")))
    return _found(own, F.col("path"), F.concat(F.lit("references its own step: "), "to_field"))


@rule("REF-005")
def table_targets_declared(c: Corpus) -> DataFrame:
    listed = c.declared.filter(F.col("role") == "target").select("recipe", F.lower("table_name").alias("lname")).distinct()
    targets = c.steps.filter((F.col("kind") == "table") & ~_blank("name")).withColumn("lname", F.lower("name"))
    return _found(targets.join(listed.hint("shuffle_hash"), ["recipe", "lname"], "left_anti"), _step(".target.name"),
                  F.concat(F.lit("table target is not declared: "), "name"))


_SEP = "\u0001"


@rule("REF-006")
def acyclic(c: Corpus) -> DataFrame:
    known = c.names
    refs = (c.refs.filter(~_blank("to_step")).select("recipe", F.lower("table").alias("lname"), F.lower("to_step").alias("to")).distinct()
            .join(known, ["recipe", "lname"], "left_semi").filter(F.col("lname") != F.col("to")))
    edges = refs.select(F.concat_ws(_SEP, "recipe", "lname").alias("src"), F.concat_ws(_SEP, "recipe", "to").alias("dst"))
    part = F.split("node", _SEP)
    members = graph.cycle_members(edges).select(part[0].alias("recipe"), part[1].alias("lname"))
    at = c.steps.filter(~_blank("name")).groupBy("recipe", F.lower("name").alias("lname")).agg(F.min("step_idx").alias("step_idx"))
    return _found(members.join(at, ["recipe", "lname"]), _step(".target"), "step takes part in a reference cycle")


# --- data flow -----------------------------------------------------------------------


@rule("FLW-001")
def reachable_from_source(c: Corpus) -> DataFrame:
    at = lambda idx: F.concat_ws(_SEP, "recipe", F.col(idx).cast("string"))
    named = c.steps.filter(~_blank("name"))
    first = named.groupBy("recipe", F.lower("name").alias("lname")).agg(F.min("step_idx").alias("pred"))
    links = (c.sources.filter(~_blank("name")).select("recipe", "step_idx", F.lower("name").alias("lname")).join(first, ["recipe", "lname"])
             .filter(F.col("pred") != F.col("step_idx")).select(at("pred").alias("src"), at("step_idx").alias("dst")))
    seeds = c.sources.filter(F.col("kind") == "table").select(at("step_idx").alias("node"))
    met = graph.reachable(links, seeds)
    return _found(c.steps.withColumn("node", at("step_idx")).join(met, "node", "left_anti"), _step(".target.name"),
                  "not reachable from a step that reads a table")


@rule("FLW-002")
def declared_targets_exist(c: Corpus) -> DataFrame:
    listed = c.declared.filter(F.col("role") == "target").withColumn("lname", F.lower("table_name"))
    return _found(listed.join(c.names, ["recipe", "lname"], "left_anti"),
                  F.format_string("$.table.targetTableNames[%d]", "pos"), F.concat(F.lit("no step writes "), "table_name"))


@rule("FLW-003")
def no_orphan(c: Corpus) -> DataFrame:
    touched = c.refs.select("recipe", F.explode(F.array(F.lower("to_step"), F.lower("table"))).alias("lname")).distinct()
    named = c.steps.filter(~_blank("name")).withColumn("lname", F.lower("name"))
    # The keys touched are distinct, so a task's share of them is small and even, and a table of it beats sorting both sides.
    return _found(named.join(touched.hint("shuffle_hash"), ["recipe", "lname"], "left_anti"), _step(".target.name"), "no reference in or out")


@row_rule("FLW-004", "nodes")
def lookup_condition_bound():
    """The condition must name one of the lookup's bind variables as a whole word."""
    text = F.coalesce("condition", F.lit(""))
    named = F.exists("bind_names", lambda n: F.rlike(text, F.concat(F.lit(r"\b\Q"), n, F.lit(r"\E\b"))))
    bad = (F.col("kind") == "lookup") & (F.size("bind_names") > 0) & ~F.coalesce(named, F.lit(False))
    return bad, F.concat("path", F.lit(".condition")), F.lit("condition names none of its bind variables")


# --- expressions ------------------------------------------------------------------------


@row_rule("EXP-001", "nodes")
def call_known():
    unknown = (F.col("kind") == "call") & ~F.col("name").startswith("EXP_") & ~F.col("name").isin(PREDEFINED + MARKERS)
    return unknown, F.col("path"), F.concat(F.lit("unknown function "), "name")


@row_rule("EXP-002", "nodes")
def operator_known():
    unknown = (F.col("parent").isin(OPERATOR_CALLS) & (F.col("siblings") == 3) & (F.col("param_idx") == 1)
               & (F.col("kind") == "literal") & ~F.col("value").isin(OPERATORS))
    return unknown, F.concat("path", F.lit(".value")), F.concat(F.lit("unknown operator "), "value")


@row_rule("EXP-003", "nodes")
def match_policy_known():
    bad = (F.col("kind") == "lookup") & ~F.coalesce(F.col("match_policy").isin(MATCH_POLICIES), F.lit(False))
    return bad, F.concat("path", F.lit(".matchPolicy")), F.lit("match policy is not Any, First or Last")


# What a single rule reads more than once.
KEEP = {"TYP-UNI-001": ("steps",), "REF-001": ("steps",), "REF-003": ("steps",),
        "REF-006": ("steps",), "FLW-001": ("steps",), "FLW-003": ("steps",)}

# The columns of nodes that a single rule reads.
_REFS = ("path", "source")
NODE_COLUMNS = {"REF-001": _REFS, "REF-002": _REFS, "REF-004": _REFS, "REF-006": _REFS, "FLW-003": _REFS,
                "FLW-004": ("path", "kind", "condition", "bind_names"), "EXP-001": ("path", "kind", "name"),
                "EXP-002": ("path", "kind", "value", "parent", "param_idx", "siblings"), "EXP-003": ("path", "kind", "match_policy")}
ONLY = {**{r: lineage.REFS for r, wanted in NODE_COLUMNS.items() if wanted is _REFS}, "FLW-004": lineage.LOOKUPS, "EXP-003": lineage.LOOKUPS}

# The parts of a step that a single rule reads besides name and type; rules that are not listed read all.
_of_fields = lambda *names: tuple(f"steps.target.{f}.{n}" for f in ("fields", "weststone") for n in names)
_TREES = _of_fields("name", "transformation")
PARTS = {**{r: () for r in ("STR-002", "STR-003", "STR-004", "STR-006", "TYP-JNI-001", "REF-005", "FLW-002")},
         **{r: ("steps.sources.name",) for r in ("STR-005", "REF-003", "FLW-001")},
         "STR-007": _of_fields("name"), "STR-008": _of_fields("dataType"), "STR-009": _of_fields("name"),
         **{r: _TREES for r in ("REF-004", "REF-006", "FLW-003", "FLW-004", "EXP-001", "EXP-002", "EXP-003")}, "REF-001": (*_TREES, "steps.sources.name"),
         "REF-002": (*_TREES, "steps.target.groups", "steps.target.greencliff", "steps.target.normalizedFields", "steps.target.returnField")}


def check(rule_id: str, docs: DataFrame) -> DataFrame:
    """Violations of one rule, parsing only what it reads and keeping only tables it reads more than once."""
    return RULES[rule_id](Corpus(docs, KEEP.get(rule_id, ()), NODE_COLUMNS.get(rule_id), ONLY.get(rule_id), PARTS.get(rule_id)))


def conformance(docs: DataFrame) -> DataFrame:
    """(recipe, rule_id, severity, status, path, message) of all rules over a corpus."""
    corpus = Corpus(docs, keep=("steps", "nodes", "declared"))
    # One job each: in one union the driver holds the plans and broadcasts of all rules at once.
    path = fresh_path(docs.sparkSession, "findings")
    for grains in PASSES:
        found = _by_rows(corpus, grains)
        found.write.mode("append").parquet(path)
    for rid, fn in ACROSS.items():
        fn(corpus).select("recipe", F.lit(rid).alias("rule_id"), "path", "message").write.mode("append").parquet(path)
    failed = docs.sparkSession.read.schema(found.schema).parquet(path)
    # a recipe's failed rules are a set of at most all of them, so passes are told from one row a recipe
    rules = F.array(*[F.lit(r) for r in RULES])
    broken = failed.groupBy(F.col("recipe").alias("_r")).agg(F.collect_set("rule_id").alias("broken"))
    kept = F.array_except(rules, F.coalesce("broken", F.array().cast("array<string>")))
    passed = (docs.select("recipe").join(broken, F.col("recipe") == F.col("_r"), "left").select("recipe", F.explode(kept).alias("rule_id"))
              .withColumns({"status": F.lit("pass"), "path": F.lit(None).cast("string"), "message": F.lit(None).cast("string")}))
    level = F.when(F.col("rule_id").isin(WARNINGS), "warning").otherwise("error")
    return (failed.withColumn("status", F.lit("fail")).unionByName(passed).withColumn("severity", level)
            .select("recipe", "rule_id", "severity", "status", "path", "message"))


def validity(results: DataFrame) -> DataFrame:
    """(recipe, errors, warnings, valid): valid means no failed error rule."""
    failed = F.col("status") == "fail"
    return results.groupBy("recipe").agg(
        F.count_if(failed & (F.col("severity") == "error")).alias("errors"),
        F.count_if(failed & (F.col("severity") == "warning")).alias("warnings")).withColumn("valid", F.col("errors") == 0)
