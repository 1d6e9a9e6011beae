"""Logs of node changes whose writers differ in payload layout and spelling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ways in which writers name a record's transaction, class and node. Text of any JSON value; objects stay JSON.
_TX_FIELDS = "tx_id string, txId string, tx string"
_NODE_FIELDS = "class string, nid string, target string, props string, node struct<class: string, nid: string>, rows array<struct<nid: string, props: string>>, nids array<string>"
_TX = "coalesce(j.tx_id, j.txId, if(startswith(j.tx, '{'), get_json_object(j.tx, '$.id'), try_cast(j.tx as bigint) :: string))"
_CLASS = "coalesce(j.class, j.node.class, regexp_extract(j.target, '^(.*)/[^/]*$', 1))"
_NID = "coalesce(try_cast(j.nid as bigint), try_cast(j.node.nid as bigint), try_cast(regexp_extract(j.target, '([^/]*)$', 1) as bigint))"
_ITEMS = f"""concat(
    array(struct({_NID} as nid, j.props as props)),
    coalesce(transform(j.rows, r -> struct(try_cast(r.nid as bigint) as nid, r.props as props)), array()),
    coalesce(transform(j.nids, n -> struct(try_cast(n as bigint) as nid, cast(null as string) as props)), array()))"""


def kind_of(kind: str) -> str:
    """SQL for a record kind without case, order and separators: `node insert`, `node update`, `tx commit`, ..."""
    words = f"trim(regexp_replace(lower({kind}), '[^a-z]+', ' '))"
    return f"array_join(sort_array(split({words}, ' ')), ' ')"


#: Kinds by their words in alphabetical order.
NODE_OPS = {"insert node": "insert", "node upsert": "upsert", "node update": "update", "delete node": "delete"}
COMMIT = "commit tx"


def _once(df: DataFrame, keep: list[str], name: str, value: str) -> DataFrame:
    """`df` with a column that is computed once per row: the optimizer copies no expression out of a generator."""
    return df.selectExpr(*keep, f"inline(array(struct({value} as {name})))")


def parsed(wal: DataFrame, kinds: list[str] | None = None, nodes: bool = True) -> DataFrame:
    """`bundle`, `lsn`, `prev_lsn`, `kind` (its words in order), `tx` and `j` (the payload's fields) of the records with
    complete JSON, of `kinds` only if given; without `nodes`, of the transaction only.

    Cut-off, empty and null payloads are dropped. A payload that is complete, but has a field of an unexpected type,
    keeps the other fields. Kinds are looked at before any payload is read, and a payload is read once.
    """
    rows = _once(wal, ["bundle", "lsn", "prev_lsn", "payload"], "kind", kind_of("kind"))
    if kinds is not None:
        rows = rows.where(F.col("kind").isin(kinds))
    rows = rows.selectExpr("bundle", "lsn", "prev_lsn", "kind", "cast(payload as string) as text").where("text <> ''")
    fields = f"{_TX_FIELDS}, {_NODE_FIELDS if nodes else ''}".rstrip(", ") + ", cut_ string"
    rows = _once(rows, ["bundle", "lsn", "prev_lsn", "kind", "text"], "j", f"from_json(text, '{fields}', map('columnNameOfCorruptRecord', 'cut_'))")
    # A record is incomplete if it can't be read at all; what only has an unexpected type is looked at again.
    rows = rows.where("j is not null and if(j.cut_ is null, true, try_parse_json(text) is not null)")
    return rows.selectExpr("bundle", "lsn", "prev_lsn", "kind", f"{_TX} as tx", "j")


def node_changes(records: DataFrame) -> DataFrame:
    """One row per changed node: `bundle`, `lsn`, `prev_lsn`, `tx`, `op`, `class_name`, `pos`, `nid`, `props` (JSON).

    `class_name` is the last segment of the class after `/`, `#` or `:`. Records about edges and other kinds give none.
    """
    op = F.create_map(*[F.lit(x) for pair in NODE_OPS.items() for x in pair])
    nodes = records.where(F.col("kind").isin(*NODE_OPS)).withColumn("op", op[F.col("kind")])
    each = nodes.selectExpr("bundle", "lsn", "prev_lsn", "tx", "op", f"regexp_extract({_CLASS}, '([^/#:]*)$', 1) as class_name", f"posexplode({_ITEMS}) as (pos, item)")
    return each.selectExpr("bundle", "lsn", "prev_lsn", "tx", "op", "class_name", "pos", "item.nid", "item.props").where("nid is not null and class_name <> ''")


def commits(records: DataFrame) -> DataFrame:
    return records.where(F.col("kind") == COMMIT).select("bundle", "lsn", "prev_lsn", "tx")


def fields_of(props: str) -> str:
    """SQL for the fields that a change's `props` set, as a map of text; numbers without trailing zeros."""
    return f"try_variant_get(try_parse_json({props}), '$', 'map<string,string>')"


def typed_fields_of(props: str) -> str:
    """SQL for the same as JSON: strings in quotes, numbers, booleans and null as they are."""
    return f"transform_values(try_variant_get(try_parse_json({props}), '$', 'map<string,variant>'), (k, x) -> coalesce(to_json(x), 'null'))"


def typed(df: DataFrame, value: str) -> DataFrame:
    """`df` with `kind` (`string`, `number`, `boolean`, `null`, `object`), `text` (of strings) and `number` of the JSON in
    `value`, which goes."""
    v = F.col(value)
    kind = F.when(F.startswith(v, F.lit('"')), "string").when(v.isin("true", "false"), "boolean").when(v == "null", "null").when(v.rlike("^[{\\[]"), "object").otherwise("number")
    text = F.when(kind == "string", F.expr(f"try_variant_get(try_parse_json({value}), '$', 'string')"))
    return df.withColumns({"kind": kind, "text": text, "number": F.when(kind == "number", v.try_cast("double"))}).drop(value)
