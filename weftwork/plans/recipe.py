"""Run a declarative recipe as chained DataFrame operators.

A recipe lists steps (a target, its sources, and a tree of calls, references and
literals for each field). Steps are resolved by name, whatever their order in
the list, and the whole recipe becomes one lazy plan a target for Catalyst.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftwork.functions import scalar as S
from weftwork.functions import validate as V
from weftwork.operators import aggregates as A
from weftwork.operators import joins, rows, sets, windows
from weftwork.operators.keys import dense_index
from weftwork.operators.lookups import lookup, lookup_where
from weftwork.sources.files import KEY_ALIASES, TYPE_ALIASES

# Run-time data types of fields and their Spark types.
RUNTIME_TYPES = {"String": "string", "BigDecimal": "decimal(38,9)", "Long": "bigint", "Integer": "int",
                 "LocalDateTime": "timestamp_ntz", "Timestamp": "timestamp_ntz", "LocalDate": "date", "Boolean": "boolean"}


@dataclass(frozen=True)
class Arg:
    """An argument: its Column, the constant it came from if it is one, and the rows it is computed over."""

    col: Column
    raw: object = None
    constant: bool = False
    df: DataFrame | None = None

    def value(self):
        """The constant; an argument that must be known when the plan is built raises if it is computed."""
        if not self.constant:
            raise ValueError("this argument must be a constant")
        return self.raw

    def either(self):
        """The constant if there is one, else the Column."""
        return self.raw if self.constant and self.raw is not None else self.col

    def kind(self) -> str:
        return self.df.select(self.col.alias("x")).dtypes[0][1] if self.df is not None else ""


def _flag(a: Arg) -> bool:
    return str(a.value()).lower() not in ("0", "false", "none")


def _values(args) -> list:
    return [a.value() for a in args]


def _replace_chr(flag: Arg, s: Arg, old: Arg, new: Arg) -> Column:
    if old.constant and new.constant:
        return S.replace_chr(_flag(flag), s.col, old.raw, new.raw or "")
    if not _flag(flag):
        raise ValueError("REPLACECHR without regard to case needs constants")
    # TRANSLATE drops or swaps single characters; longer replacements need constants.
    return F.translate(s.col, old.col, F.when(F.coalesce(new.col, F.lit("")) == "", "").otherwise(F.repeat(F.substring(new.col, 1, 1), F.length(old.col))))


def _replace_str(flag: Arg, s: Arg, *rest: Arg) -> Column:
    olds, new = rest[:-1], rest[-1]
    if all(a.constant for a in rest):
        return S.replace_str(_flag(flag), s.col, _values(olds), new.raw or "")
    if len(olds) > 1 or not _flag(flag):
        raise ValueError("REPLACESTR with computed arguments takes one text and regards case")
    return F.replace(s.col, olds[0].col, F.coalesce(new.col, F.lit("")))


def _trunc(x: Arg, *f: Arg) -> Column:
    if x.kind().startswith(("timestamp", "date")):
        return S.trunc_date(x.col, *_values(f))
    return S.trunc_number(x.col, *_values(f))


# Call name → how its arguments become a Column. Arguments may be computed, except where ``value`` asks for a constant.
CALLS: dict[str, Callable[..., Column]] = {
    "TO_DATE": lambda s, f: S.to_date(s.col, f.value()),
    "TO_CHAR": lambda x, f=None: S.to_char(x.col, f and f.value()),
    "LPAD": lambda s, n, *p: S.lpad(s.col, *[a.either() for a in (n, *p)]),
    "RPAD": lambda s, n, *p: S.rpad(s.col, *[a.either() for a in (n, *p)]),
    "SUBSTR": lambda s, a, *n: S.substr(s.col, *[x.either() for x in (a, *n)]),
    "REPLACECHR": _replace_chr,
    "REPLACESTR": _replace_str,
    "TO_DECIMAL": lambda x, *n: S.to_decimal(x.col, *_values(n)),
    "CONCAT": lambda *xs: reduce(S.concat, [x.col for x in xs]),
    "TRUNC": _trunc,
    "TO_INTEGER": lambda x, *_: S.to_integer(x.col),
    "LENGTH": lambda s: S.length(s.col),
    "UPPER": lambda s: S.upper(s.col),
    "LOWER": lambda s: S.lower(s.col),
    "TRIM": lambda s: S.trim(s.col),
    "ISNULL": lambda x: S.isnull(x.col),
    "IS_NUMBER": lambda s: S.is_number(s.col),
    "IS_SPACES": lambda s: S.is_spaces(s.col),
    "IS_DATE": lambda s, *f: S.is_date(s.col, *_values(f)),
    "INSTR": lambda s, sub, *r: S.instr(s.col, sub.either(), *[a.either() for a in r[:1]], *_values(r[1:])),
    "IN": lambda v, *cs: S.in_(v.col, *[c.col for c in cs]),
    "IIF": lambda c, a, *b: S.iif(c.col, a.col, *[x.col for x in b]),
    "DECODE": lambda v, *xs: S.decode(v.col, *[x.col for x in xs]),
    "GREATEST": lambda *xs: S.greatest(*[x.col for x in xs]),
    "LEAST": lambda *xs: S.least(*[x.col for x in xs]),
    "ABS": lambda x: S.abs_(x.col),
    "ROUND": lambda x, *n: S.round_(x.col, *_values(n)),
    "ADD_TO_DATE": lambda d, part, n: S.add_to_date(d.col, part.value(), n.col),
    "LAST_DAY": lambda d: S.last_day(d.col),
    "DATE_DIFF": lambda a, b, part: S.date_diff(a.col, b.col, part.value()),
    "GET_DATE_PART": lambda d, part: S.get_date_part(d.col, part.value()),
    "CHR": lambda n: S.chr_(n.col),
    "REG_MATCH": lambda s, p: S.reg_match(s.col, p.either()),
    "REG_REPLACE": lambda s, p, r, *_: F.regexp_replace(s.col, p.col, F.coalesce(r.col.cast("string"), F.lit(""))),
    "GET_SYSTEM_DATE": lambda *_: S.sysdate(),
    "NEGATION": lambda x: S.not_(x.col),
    "NOT": lambda x: S.not_(x.col),
    "NVL": lambda a, b: S.nvl(a.col, b.col),
    "ARITHMETIC": lambda a, op, b: S.arithmetic(a.col, op.value(), b.col),
    "COMPARISON": lambda a, op, b: S.comparison(a.col, op.value(), b.col),
    "LOGICAL": lambda a, op, b: S.logical(a.col, op.value(), b.col),
    "SUM": lambda x, *w: A.sum_(x.col, *[c.col for c in w]),
    "COUNT": lambda x, *w: F.count("*") if x.raw == "*" else A.count_(x.col, *[c.col for c in w]),
    "MAX": lambda x, *w: A.max_(x.col, *[c.col for c in w]),
    "MIN": lambda x, *w: A.min_(x.col, *[c.col for c in w]),
    "AVG": lambda x, *w: A.avg_(x.col, *[c.col for c in w]),
}
AGGREGATES = {"SUM", "COUNT", "MAX", "MIN", "AVG"}


def register_call(name: str, fn: Callable[..., Column]) -> None:
    """Make a shared expression callable from recipes."""
    CALLS[name.removeprefix("EXP_")] = lambda *args: fn(*[a.col for a in args])


def _constant(text: str):
    text = str(text)
    if len(text) >= 2 and text[0] == text[-1] == "'":
        return text[1:-1].replace("''", "'")
    if re.fullmatch(r"[+-]?\d+", text):
        number = int(text)
        return number if -(1 << 63) <= number < 1 << 63 else Decimal(text)
    if text.upper() in ("TRUE", "FALSE"):
        return text.upper() == "TRUE"
    return None if text.upper() == "NULL" else text


MIRRORED = {"<": ">", ">": "<", "<=": ">=", ">=": "<="}

# Tokens that stand for call names in anonymised recipes.
CALL_ALIASES = {"MAPLEVALE_": "VALIDATION_", "OAKPEAK": "COMPARISON"}


def _call_name(node: dict) -> str:
    name = node["name"].removeprefix("EXP_")
    for token, meaning in CALL_ALIASES.items():
        if name.startswith(token):
            return meaning + name.removeprefix(token)
    return name


def _is_validation(node: dict | None) -> bool:
    return bool(node and node.get("name") and "outputField" not in node and _call_name(node).startswith("VALIDATION_"))


def validation(name: str, raw: Column, constants: list, formats: dict[str, list[str]]) -> V.Rule:
    """The rule of a validation call: its kind, then NOT_NULL or DEFAULT anywhere in the name; other parts name a feed.

    The formats of dates and timestamps are the call's constants, else those declared in ``formats`` under the call's name, else the
    accepted ones. DECIMAL takes precision and scale (38, 9), a default of NOT_NULL_DEFAULT is its constant.
    """
    rest = name.removeprefix("VALIDATION_")
    not_null, default = "NOT_NULL" in rest, rest.endswith("_DEFAULT")
    declared = [str(c) for c in constants if c is not None] or formats.get(name)
    if rest.startswith("NUM"):
        return V.num(raw, not_null)
    if rest.startswith("DECIMAL"):
        rule = V.decimal(raw, *([int(c) for c in constants[:2]] or (38, 9)))
        return V.Rule(rule.raw, rule.typed, rule.code, not_null)
    if rest.startswith(("TIMESTAMP", "DATETIME")):
        return V.timestamp(raw, declared, not_null)
    if rest.startswith("DATE"):
        return V.date(raw, declared, not_null, default)
    if not_null:
        return V.present(raw, str(constants[0]) if default and constants else None)
    raise ValueError(f"unknown validation {name}")


def _params(node: dict) -> list[dict]:
    return [p.get("transformation", {}) if "transformation" in p else p for p in node.get("parameters", [])]


def _walk(node: dict):
    yield node
    for p in _params(node):
        yield from _walk(p)


def conjuncts(text: str) -> list[tuple[str, str, str]]:
    """``A = B AND C <= D`` as triples of names; table qualifiers are dropped."""
    out = []
    for part in re.split(r"\s+AND\s+", text.strip(), flags=re.IGNORECASE):
        m = re.fullmatch(r"\s*([\w$#.]+)\s*(<=|>=|<>|!=|\^=|=|<|>)\s*([\w$#.]+)\s*", part)
        if not m:
            raise ValueError(f"cannot read condition {part!r}")
        out.append((m[1].split(".")[-1], m[2], m[3].split(".")[-1]))
    return out


def between(text: str, master: list[str], detail: list[str]) -> list[tuple[str, str, str]]:
    """The triples of a join condition as (master port, operator, detail port); equal names on both sides are told apart by
    their qualifiers MASTER and DETAIL, or by standing left and right."""
    mirror = {"<": ">", ">": "<", "<=": ">=", ">=": "<="}
    out = []
    for part, (a, op, b) in zip(re.split(r"\s+AND\s+", text.strip(), flags=re.IGNORECASE), conjuncts(text)):
        swapped = a not in master or b not in detail or re.match(r"\s*(\w+\.)*DETAIL\.", part, re.IGNORECASE)
        if swapped and (b not in master or a not in detail):
            raise ValueError(f"condition {part!r} does not link master and detail")
        out.append((b, mirror.get(op, op), a) if swapped else (a, op, b))
    return out


@dataclass
class Run:
    """One run of a recipe over named tables; ``order`` gives the row order a table or step needs."""

    spark: SparkSession
    steps: dict[str, dict]
    tables: dict[str, DataFrame]
    params: dict[str, object] = field(default_factory=dict)
    order: dict[str, list[str]] = field(default_factory=dict)
    code: dict[str, Callable] = field(default_factory=dict)
    formats: dict[str, list[str]] = field(default_factory=dict)
    checked: dict[str, DataFrame] = field(default_factory=dict)
    done: dict[str, DataFrame | dict[str, DataFrame]] = field(default_factory=dict)

    def step(self, name: str):
        if name not in self.done:
            self.done[name] = self._build(name, self.steps[name])
        return self.done[name]

    # A source is read as columns named `SOURCE.FIELD`, so inputs never clash.
    def _source(self, src: dict) -> DataFrame:
        name, kind = src["name"], TYPE_ALIASES.get(src["type"], src["type"])
        if kind == "table" and name not in self.steps:
            df = self.tables[name]
        elif kind == "router":
            df = self.step(name)[src["group"]]
        elif kind == "union":
            maps = {t["name"]: {m["origin"]: m["union"] for m in t["fieldMapping"]} for t in src["unionTables"]}
            df = sets.union_groups({t: self.step(t) for t in maps}, maps)
        elif kind == "joiner":
            df = self._joined(src)
        else:
            df = self.step(name)
        return df.select(*[F.col(f"`{c}`").alias(f"{name}.{c}") for c in df.columns])

    def _joined(self, src: dict) -> DataFrame:
        sides = {t.rsplit(".", 1)[1]: self.step(t) for t in src["joinerTables"]}
        master, detail = sides["MASTER"], sides["DETAIL"]
        return joins.joiner(master, detail, between(src["joinerCondition"], master.columns, detail.columns), src["joinerType"])

    def _input(self, step: dict) -> DataFrame:
        target, sources = step["target"], [self._source(s) for s in step["sources"]]
        if len(sources) == 1:
            return sources[0]
        text = target.get("userDefinedJoin")
        if not text:
            raise ValueError(f"{target['name']}: several sources need a join")
        return self._linked(sources, [tuple(x.strip() for x in c.split("=")) for c in re.split(r"\s+AND\s+", text, flags=re.I)])

    def _linked(self, sources: list[DataFrame], equalities: list[tuple[str, str]]) -> DataFrame:
        """Join each source on the equalities that link it to those already joined."""
        joined, rest = sources[0], sources[1:]
        while rest:
            for df in rest:
                on = [(a, b) for a, b in equalities if {a, b} <= {*joined.columns, *df.columns} and (a in df.columns) != (b in df.columns)]
                if on:
                    joined = joined.join(df, [joined[f"`{a}`"] == df[f"`{b}`"] if a in joined.columns
                                              else joined[f"`{b}`"] == df[f"`{a}`"] for a, b in on])
                    rest = [r for r in rest if r is not df]
                    break
            else:
                raise ValueError("sources are not linked by an equality")
        return joined

    # --- expressions ---

    def _ref(self, source: str, df: DataFrame) -> Column:
        table, name = source.split(".", 1)
        port = name.rsplit(".", 1)[-1]
        column = f"{table}.{name}" if f"{table}.{name}" in df.columns else f"{table}.{port}"
        if column not in df.columns:
            raise ValueError(f"no input port {source}; have {df.columns}")
        return F.col(f"`{column}`")

    def _arg(self, node: dict, df: DataFrame) -> Arg:
        if "value" in node and "name" not in node:
            text = str(node["value"])
            if text.startswith("$$"):
                return Arg(F.lit(self.params[text[2:]]), self.params[text[2:]], True, df)
            raw = _constant(text)
            exact = isinstance(raw, str) and re.fullmatch(r"[+-]?\d*\.\d+", text)
            return Arg(F.lit(text).cast("decimal(38,9)") if exact else F.lit(raw), raw, True, df)
        return Arg(self._column(node, df), df=df)

    def _rule(self, node: dict, df: DataFrame) -> V.Rule:
        """The rule of a validation and those inside it: blanks are an error if any says so, the outermost gives the type."""
        first, *rest = [self._arg(p, df) if not _is_validation(p) else p for p in _params(node)]
        inner = self._rule(first, df) if isinstance(first, dict) else None
        rule = validation(_call_name(node), inner.raw if inner else first.col.cast("string"), [a.value() for a in rest], self.formats)
        if inner:
            rule = V.Rule(rule.raw, rule.typed, rule.code, rule.not_null or inner.not_null, inner.default if rule.default is None else rule.default)
        return rule

    def _column(self, node: dict | None, df: DataFrame) -> Column:
        if not node:
            return F.lit(None)
        if "outputField" in node:
            return F.col(f"`{self._lookup_column(node)}`")
        if node.get("name"):
            name = _call_name(node)
            if name == "SequenceGenerator":
                return F.col("_nextval")
            if _is_validation(node):
                return self._rule(node, df).struct()["value"]
            if name not in CALLS:
                raise ValueError(f"unknown function {node['name']}")
            return CALLS[name](*[self._arg(p, df) for p in _params(node)])
        if "source" in node:
            return self._ref(node["source"], df)
        return self._arg(node, df).col

    @staticmethod
    def _lookup_id(node: dict) -> str:
        return json.dumps({k: v for k, v in node.items() if k != "outputField"}, sort_keys=True)

    def _lookup_column(self, node: dict) -> str:
        return f"_lkp{hashlib.md5(self._lookup_id(node).encode()).hexdigest()}_{node['outputField']}"

    def _with_lookups(self, trees: list[dict], df: DataFrame) -> DataFrame:
        """Join each distinct lookup once, with all ports asked of it, inner lookups first."""
        found: dict[str, list[dict]] = {}
        for tree in trees:
            for node in reversed(list(_walk(tree))):
                if "outputField" in node:
                    found.setdefault(self._lookup_id(node), []).append(node)
        for nodes in found.values():
            first = nodes[0]
            table = (self.spark.sql(first["sqlOverride"], **self.tables) if first.get("sqlOverride")
                     else self.tables[first["table"]])
            if first.get("sourceFilter"):
                table = table.filter(first["sourceFilter"])
            binds = {p["name"]: F.lit(None) for p in first["parameters"]}
            for p in first["parameters"]:
                binds[p["name"]] = self._column(p.get("transformation"), df)
            df = df.withColumns({f"_bind_{n}": c for n, c in binds.items()})
            outputs = {self._lookup_column(n): n["outputField"] for n in nodes}
            policy = first.get("matchPolicy", "First")
            order = self.order.get(first["table"], table.columns)
            cond = [(a, op, b) if b in binds else (b, MIRRORED.get(op, op), a)
                    for a, op, b in conjuncts(first["condition"])]
            if all(op == "=" for _, op, _ in cond):
                df = lookup(df, table, [(f"_bind_{b}", a) for a, _, b in cond], outputs, policy, order)
            else:
                df = lookup_where(df, table, [(f"_bind_{b}", MIRRORED.get(op, op), a) for a, op, b in cond], outputs, policy, order)
            df = df.drop(*[f"_bind_{n}" for n in binds])
        return df

    # --- kinds ---

    def _build(self, name: str, step: dict):
        target = {KEY_ALIASES.get(k, k): v for k, v in step["target"].items()}
        kind = TYPE_ALIASES.get(target["type"], target["type"])
        if target.get("sqlQuery"):
            return self._fields(target, self._prefixed(rows.parametrised_sql(self.spark, target["sqlQuery"], self.params, **self.tables), step))
        df = self._input(step)
        if target.get("sourceFilter"):
            df = self._plain(df, step).where(target["sourceFilter"])
            df = self._prefixed(df, step)
        trees = [f["transformation"] for f in target["fields"] if f.get("transformation")]
        cond = target.get("filterCondition")
        df = self._with_lookups(trees + ([cond] if isinstance(cond, dict) else []), df)
        if any(n.get("name") == "SequenceGenerator" for t in trees for n in _walk(t)):
            df = dense_index(df, [F.col(f"`{c}`") for c in self.order[name]], "_nextval")
        if kind == "filter" and cond:
            df = rows.keep_true(df, self._column(cond, df))
        if kind == "aggregator":
            return self._aggregated(name, target, df)
        out = self._fields(target, df)
        if kind == "sourceQualifier" and target.get("selectDistinct"):
            return rows.select_distinct(out)
        if kind == "router":
            conds = {g["name"]: F.expr(g["filterCondition"]) for g in target["groups"] if not g.get("default")}
            default = next((g["name"] for g in target["groups"] if g.get("default")), None)
            return {g: self._group_ports(name, df, target["groups"]) for g, df in rows.route(out, conds, default).items()}
        if kind == "normalizer":
            repeated = {f["name"]: f["refSource"] for f in target["normalizedFields"]}
            ids, keys = ({f["name"] for f in target["normalizedFields"] if f.get(k)} for k in ("generatedColumnId", "generatedKey"))
            made = rows.normalize(out, repeated, bool(ids), bool(keys), order_by=self.order.get(name))
            wanted = {f"GCID_{f}" for f in ids} | {f"GK_{f}" for f in keys}
            return made.drop(*[c for c in made.columns if c.startswith(("GCID_", "GK_")) and c not in wanted and c not in repeated])
        if kind == "java":
            return rows_code(out, self.code[name])
        if kind == "storedProcedure":
            inputs = [F.col(f["name"]) for f in target["fields"]]
            return out.withColumn(target["returnField"], self.code[target["procedureName"]](*inputs))
        return out

    @staticmethod
    def _group_ports(name: str, df: DataFrame, groups: list[dict]) -> DataFrame:
        """The router's ports, and those that a group gives them under names of its own."""
        own = {}
        for g in groups:
            for f in g.get("fields") or []:
                source = (f.get("transformation") or {}).get("source", "").removeprefix(f"{name}.")
                if source in df.columns and f["name"] not in df.columns:
                    own[f["name"]] = F.col(f"`{source}`").cast(RUNTIME_TYPES[f["dataType"]])
        return df.withColumns(own) if own else df

    def _plain(self, df: DataFrame, step: dict) -> DataFrame:
        name = step["sources"][0]["name"]
        return df.select(*[F.col(f"`{c}`").alias(c.split(".", 1)[1]) for c in df.columns]).alias(name)

    def _prefixed(self, df: DataFrame, step: dict) -> DataFrame:
        name = step["sources"][0]["name"]
        return df.select(*[F.col(c).alias(f"{name}.{c}") for c in df.columns])

    def _fields(self, target: dict, df: DataFrame) -> DataFrame:
        """The step's ports. Where fields are validated, ``errors`` and ``LOAD_DATA`` follow them, unless ports of these names exist."""
        checks = {f["name"]: self._rule(f["transformation"], df) for f in target["fields"] if _is_validation(f.get("transformation"))}
        if not checks:
            return rows.project(df, [rows.Field(f["name"], self._column(f.get("transformation"), df), RUNTIME_TYPES[f["dataType"]])
                                     for f in target["fields"]])
        others = {f["name"]: self._column(f.get("transformation"), df) for f in target["fields"] if f["name"] not in checks}
        done = V.validate(df.withColumns({f"_port_{n}": c for n, c in others.items()}), {f"_checked_{n}": r for n, r in checks.items()})
        errors = F.transform("errors", lambda e: F.regexp_replace(e, "^_checked_", ""))
        typed = [F.col(f"`_checked_{f['name']}`" if f["name"] in checks else f"`_port_{f['name']}`").try_cast(RUNTIME_TYPES[f["dataType"]]).alias(f["name"]) for f in target["fields"]]
        made = {f["name"] for f in target["fields"]}
        out = done.select(*typed, *[c for n, c in (("errors", errors.alias("errors")), ("LOAD_DATA", F.col("LOAD_DATA"))) if n not in made])
        self.checked[target["name"]] = out
        return out

    def _aggregated(self, name: str, target: dict, df: DataFrame) -> DataFrame:
        by = set(target["groupByFields"])
        keyed = {f["name"]: self._column(f.get("transformation"), df) for f in target["fields"] if f["name"] in by}
        rest = [f for f in target["fields"] if f["name"] not in by]
        computed = {f["name"]: self._column(f.get("transformation"), df) for f in rest if any(
            n.get("name") and _call_name(n) in AGGREGATES for n in _walk(f.get("transformation") or {}))}
        last = {f["name"]: self._column(f.get("transformation"), df) for f in rest if f["name"] not in computed}
        staged = df.withColumns({f"_by_{n}": c for n, c in keyed.items()} | {f"_last_{n}": c for n, c in last.items()})
        order = self.order.get(name)
        if last and not order:
            raise ValueError(f"aggregator {name}: the last row of {sorted(last)} needs an order")
        out = A.aggregate(staged, [f"_by_{n}" for n in keyed], computed, [f"_last_{n}" for n in last],
                          [F.col(f"`{c}`") for c in order or []])
        types = {f["name"]: RUNTIME_TYPES[f["dataType"]] for f in target["fields"]}
        src = {**{n: f"_by_{n}" for n in keyed}, **{n: f"_last_{n}" for n in last}, **{n: n for n in computed}}
        return out.select(*[F.col(src[f["name"]]).try_cast(types[f["name"]]).alias(f["name"]) for f in target["fields"]])


def rows_code(df: DataFrame, code: tuple[Callable, str]) -> DataFrame:
    from weftwork.operators.udf import row_code

    fn, schema = code
    return row_code(df, fn, schema)


def _started(spark, recipe, tables, params, order, code, formats) -> tuple[dict, Run]:
    doc = json.loads(recipe) if isinstance(recipe, str) else recipe
    steps = {s["target"]["name"]: s for s in doc["steps"]}
    return doc, Run(spark, steps, tables, params or {}, order or {}, code or {}, formats or {})


def run_recipe(spark: SparkSession, recipe: dict | str, tables: dict[str, DataFrame], params: dict[str, object] | None = None,
               order: dict[str, list[str]] | None = None, code: dict[str, Callable] | None = None,
               formats: dict[str, list[str]] | None = None) -> dict[str, DataFrame]:
    """Table targets of ``recipe`` by name, as lazy DataFrames.

    ``order`` names the columns that order a lookup table, an aggregator's rows, a generated key; ``code``
    gives the functions of java steps (function, schema) and procedures (Column function); ``formats`` the
    date formats of validation calls by name. A target that validates fields has ``errors`` and ``LOAD_DATA`` behind its own columns.
    """
    _, run = _started(spark, recipe, tables, params, order, code, formats)
    return {n: run.step(n) for n, s in run.steps.items() if s["target"]["type"] == "table"}


@dataclass(frozen=True)
class Checked:
    """What a run with data quality gives: rows to load, rows whose duplicate keys occurred before, and all validation errors."""

    rows: dict[str, DataFrame]
    duplicates: dict[str, DataFrame]
    errors: DataFrame | None


def run_recipe_dq(spark: SparkSession, recipe: dict | str, tables: dict[str, DataFrame], params: dict[str, object] | None = None,
                  order: dict[str, list[str]] | None = None, code: dict[str, Callable] | None = None,
                  formats: dict[str, list[str]] | None = None, keys: dict[str, list[str]] | None = None) -> Checked:
    """Run a recipe and part good rows, duplicates and errors.

    ``errors`` holds (step, key, field, code, raw) of every step that validates; ``key`` is the JSON of the step's columns in ``keys``. Targets hold
    only rows with ``LOAD_DATA`` = 'Y'. The recipe's duplicate keys (``table.dq2.keys``) apply to every target that has all of
    them: the first row of a key by ``order`` (else by the keys and then all columns) stays.
    """
    doc, run = _started(spark, recipe, tables, params, order, code, formats)
    names = [n for n, s in run.steps.items() if s["target"]["type"] == "table"]
    out = {n: run.step(n) for n in names}
    section = {KEY_ALIASES.get(k, k): v for k, v in doc.get("table", {}).items()}
    dq2 = (section.get("dq2") or {}).get("keys") or []
    good, again, errors = {}, {}, None
    for name, df in out.items():
        if name in run.checked and "errors" in df.columns:
            df, _ = V.split(df, [])
        if dq2 and set(dq2) <= set(df.columns):
            df, again[name] = windows.split_duplicates(df, dq2, run.order.get(name, dq2))
        good[name] = df
    for name, df in run.checked.items():
        if "errors" in df.columns:
            key = F.to_json(F.struct(*(keys or {}).get(name, []))) if (keys or {}).get(name) else F.lit(None).cast("string")
            _, bad = V.split(df.withColumn("key", key), ["key"])
            bad = bad.select(F.lit(name).alias("step"), "key", "field", "code", "raw")
            errors = bad if errors is None else errors.unionByName(bad)
    return Checked(good, again, errors)
