"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SHARED_SHINGLES = rf"""
with recursive split as (
  select doc_id, regexp_extract_all({LOWERED}, '[^\x20\x09-\x0D]+') as w from documents
), sets as (
  select doc_id, case when len(w) = 0 then []
    else list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) end as s
  from split
), items as (select doc_id, unnest(s) as item from sets),
pairs as (
  select x.doc_id as a, y.doc_id as b, count(*) as n from items x join items y on x.item = y.item and x.doc_id <> y.doc_id
  group by 1, 2
), links as (
  select a, b from pairs join sets p on p.doc_id = a join sets q on q.doc_id = b
  where 100 * n >= 75 * (len(p.s) + len(q.s) - n)
), reach(a, b) as (
  select a, b from links union select r.a, l.b from reach r join links l on r.b = l.a
)
select s.doc_id, len(s.s)::bigint as n_shingles, least(s.doc_id, coalesce(min(r.b), s.doc_id)) as component_id,
  s.doc_id = least(s.doc_id, coalesce(min(r.b), s.doc_id)) as kept
from sets s left join reach r on r.a = s.doc_id group by s.doc_id, len(s.s)
"""

COMMON_LINES = f"""
with lines as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos
  from documents
), keyed as (
  select doc_id, pos, line,
    trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as key
  from lines
), frequent as (
  select key from keyed where length(key) >= 1 group by key having count(distinct doc_id) >= 10
)
select doc_id, count(*) as n_lines, count(f.key) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (f.key is null), '')) as kept_sha256
from keyed left join frequent f on keyed.key = f.key group by doc_id
"""

LINKED_VECTORS = """
with recursive usable as (
  select vec_id, label, embedding::double[] as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0
), links as (
  select x.vec_id as a, y.vec_id as b from usable x join usable y
    on x.label = y.label and x.vec_id <> y.vec_id and len(x.v) = len(y.v)
  where list_cosine_similarity(x.v, y.v) >= 0.93
), reach(a, b) as (
  select a, b from links union select r.a, l.b from reach r join links l on r.b = l.a
), degree as (select a, count(*) as n from links group by a),
least_id as (select a, min(b) as b from reach group by a)
select e.vec_id, coalesce(n, 0) as n_links, least(e.vec_id, coalesce(b, e.vec_id)) as component_id,
  e.vec_id = least(e.vec_id, coalesce(b, e.vec_id)) as kept
from embeddings e left join degree d on d.a = e.vec_id left join least_id r on r.a = e.vec_id
"""

MERKLE = """
with recursive field as (
  select doc_id, source, coalesce('s' || source, '') as tree,
    coalesce(strlen(doc_id::varchar) || ':' || doc_id::varchar, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::varchar) || ':' || n_chars::varchar, '-') as head,
    text, list_reduce(
      list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint)),
      lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)),
        lambda x, k: xor(x >> 1, case when x & 1 = 1 then 3988292384 else 0 end))) as crc
  from documents
), leaf as (
  select doc_id, tree, sha256(head || coalesce(strlen(text) || ':' || text, '-')) as leaf,
    sha256(head || coalesce(strlen(changed) || ':' || changed, '-')) as claimed
  from (select *, case when xor(crc, 4294967295) % 2 = 0 then replace(text, chr(10), '') else text end as changed from field)
), placed as (
  select *, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as rank,
    count(*) over (partition by tree) as size
  from leaf
), node(tree, level, size, idx, digest) as (
  select tree, 0, size, rank, leaf from placed
  union all
  select tree, level + 1, (size + 2) // 3, idx // 3, sha256(string_agg(digest, '' order by idx)) from node where size > 1
  group by tree, level, size, idx // 3
), subroot as (
  select tree, digest, row_number() over (order by tree) - 1 as rank, count(*) over () as size from node where size = 1
), top(level, size, idx, digest) as (
  select 0, size, rank, digest from subroot
  union all
  select level + 1, (size + 2) // 3, idx // 3, sha256(string_agg(digest, '' order by idx)) from top where size > 1
  group by level, size, idx // 3
), run as (
  select tree, level, idx // 3 as at, list(digest order by idx) as nodes from node where size > 1 group by 1, 2, 3
), top_run as (
  select level, idx // 3 as at, list(digest order by idx) as nodes from top where size > 1 group by 1, 2
), fold(doc_id, tree, leaf, rank, level, idx, node, proof) as (
  select doc_id, tree, leaf, rank, 0, rank, claimed, '' from placed
  union all
  select f.doc_id, f.tree, f.leaf, f.rank, f.level + 1, f.idx // 3,
    sha256(array_to_string(nodes[1:f.idx % 3], '') || f.node || array_to_string(nodes[f.idx % 3 + 2:], '')),
    f.proof || array_to_string(nodes[1:f.idx % 3], '') || array_to_string(nodes[f.idx % 3 + 2:], '')
  from fold f join run r on r.tree = f.tree and r.level = f.level and r.at = f.idx // 3
), half as (
  select f.*, s.digest as subroot, s.rank as s_rank from fold f join subroot s on s.tree = f.tree
  join (select tree, max(level) as height from node group by tree) h on h.tree = f.tree and h.height = f.level
), whole(doc_id, leaf, subroot, level, idx, node, proof) as (
  select doc_id, leaf, subroot, 0, s_rank, node, proof from half
  union all
  select f.doc_id, f.leaf, f.subroot, f.level + 1, f.idx // 3,
    sha256(array_to_string(nodes[1:f.idx % 3], '') || f.node || array_to_string(nodes[f.idx % 3 + 2:], '')),
    f.proof || array_to_string(nodes[1:f.idx % 3], '') || array_to_string(nodes[f.idx % 3 + 2:], '')
  from whole f join top_run r on r.level = f.level and r.at = f.idx // 3
)
select doc_id, leaf, subroot, digest as root, sha256(proof) as proof_sha256, node as folded_root, node = digest as verified
from whole w join (select level as height, digest from top where size = 1) t on t.height = w.level
"""

ORACLES = {
    "op2_minhash_near_dedup": SHARED_SHINGLES,
    "op7_line_dedup": COMMON_LINES,
    "op10_embedding_near_dedup": LINKED_VECTORS,
    "op12_merkle_manifest": MERKLE,
}
