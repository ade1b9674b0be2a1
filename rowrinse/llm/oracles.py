"""DuckDB SQL of the ``opN_`` queries that SQL can express."""

from __future__ import annotations


def crc32(text: str) -> str:
    """Unsigned CRC-32 of an ASCII text, bit by bit."""
    bit = "lambda c, i: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end"
    byte = f"lambda a, b: list_reduce(list_concat([xor(a, b)], [0::bigint, 0, 0, 0, 0, 0, 0, 0]), {bit})"
    codes = f"list_transform(string_split({text}, ''), lambda x: ord(x)::bigint)"
    return f"xor(list_reduce(list_concat([4294967295::bigint], {codes}), {byte}), 4294967295)"


def _level(nodes: str, k: int) -> str:
    """The nodes of level ``k`` with their siblings, and those of the next; a tree down to one node stays as it is."""
    run = "partition by tree, place // 8 order by place rows between"
    return (
        f"{nodes}{k}s as materialized (select *, coalesce(string_agg(digest, '') over ({run} unbounded preceding and 1 preceding), '') as l,"
        f" coalesce(string_agg(digest, '') over ({run} 1 following and unbounded following), '') as r from {nodes}{k}),\n"
        f"{nodes}{k + 1} as materialized (select tree, place // 8 as place, any_value(n) as n,"
        f" case when any_value(n) > {8**k} then sha256(string_agg(digest, '' order by place)) else any_value(digest) end as digest"
        f" from {nodes}{k} group by tree, place // 8)"
    )


def merkle(levels: int = 8, upper: int = 4) -> str:
    def field(value: str) -> str:
        return f"coalesce(strlen({value}) || ':' || {value}, '-')"

    def leaf(text: str) -> str:
        values = ("cast(doc_id as varchar)", "source", "lang", "cast(n_chars as varchar)", text)
        return f"sha256({' || '.join(map(field, values))})"

    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    # the folded digest has one column per level, each from the one before
    proof, joins, steps, previous = [], [], [], "first"
    for nodes, count, key, tree, height in (("t", "n", "place", "d.tree", levels), ("u", "trees", "tree", "0", upper)):
        for k in range(height):
            at, many = f"{nodes}{k}j", f"d.{count} > {8**k}"
            joins.append(f"join {nodes}{k}s {at} on {at}.tree = {tree} and {at}.place = d.{key} // {8**k}")
            proof.append(f"case when {many} then {at}.l || {at}.r else '' end")
            steps.append(f"case when {many} then sha256({at}.l || {previous} || {at}.r) else {previous} end as f_{nodes}{k}")
            previous = f"f_{nodes}{k}"
    return (
        f"with hashed as (select *, {leaf('text')} as leaf, case when {crc32('cast(doc_id as varchar)')} % 3 = 0 then {leaf(lower)} end as changed from documents),\n"
        "d as materialized (select doc_id, leaf, coalesce(changed, leaf) as first, dense_rank() over (order by lang nulls first) - 1 as tree,"
        " row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as place, count(*) over (partition by lang) as n,"
        " (select count(*) from (select distinct lang from documents)) as trees from hashed),\n"
        "t0 as (select tree, place, n, leaf as digest from d),\n"
        + ",\n".join(_level("t", k) for k in range(levels))
        + f",\nu0 as materialized (select 0 as tree, tree as place, (select max(trees) from d) as n, digest from t{levels}),\n"
        + ",\n".join(_level("u", k) for k in range(upper))
        + f"\nselect doc_id, leaf, subroot, root, sha256(proof) as proof_sha256, {previous} as folded_root, {previous} = root as verified from ("
        f"select d.*, {', '.join(steps)}, top.digest as subroot, (select digest from u{upper}) as root, {' || '.join(proof)} as proof"
        f" from d {' '.join(joins)} join t{levels} top on top.tree = d.tree)"
    )


HARD_NEGATIVES = """with used as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v
  from embeddings
  where label is not null and embedding is not null and vec_id is not null
    and coalesce(list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false))), true)),
good as (
  select a.vec_id as anchor_id, a.label, a.v, b.vec_id as positive_id, cast(list_inner_product(a.v, b.v) as bigint) as positive_score
  from used a join used b on a.label = b.label and a.vec_id <> b.vec_id where a.vec_id % 100 = 0
  qualify row_number() over (partition by a.vec_id order by positive_score desc, b.vec_id) <= 5),
bad as (
  select anchor_id, positive_id, b.vec_id as negative_id, positive_score, cast(list_inner_product(g.v, b.v) as bigint) as negative_score
  from good g join used b on g.label <> b.label)
select anchor_id, positive_id, cast(row_number() over w as int) as rank, negative_id, positive_score, negative_score
from bad where 30 * positive_score <= 100 * negative_score and 100 * negative_score <= 90 * positive_score
window w as (partition by anchor_id, positive_id order by negative_score desc, negative_id)
qualify row_number() over w <= 10"""


# five hex digits of a SHA-1 are four symbols of base32
WARC = """
with p as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as sha from pages),
f as (select *, min(page_id) over (partition by sha) as first from p),
r as (select *, first is not null and first is distinct from page_id as again from f)
select page_id, cast(strlen(html) as bigint) as payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + cast(
    (cast('0x' || substr(sha, 1 + 5 * (i // 4), 5) as bigint) >> (15 - 5 * (i % 4))) & 31 as bigint), 1)), '') as payload_digest,
  case when again then 'revisit' else 'response' end as record_type,
  case when again then first end as refers_to,
  case when not again then sha256(html) end as payload_sha256
from r
"""
