"""DuckDB SQL for the operators whose statement takes more than one query."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ranked_search_sql(k: int = 10) -> str:
    """Term by term: join the items' terms with the documents' and add the products."""
    found = f"unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+'))"
    return f"""
        with doc_terms as (select doc_id, {found} as term from documents),
        counts as (select doc_id, term, count(*) as tf from doc_terms group by doc_id, term),
        lengths as (select doc_id, sum(tf)::bigint as n from counts group by doc_id),
        corpus as (select count(*) as docs, sum(n)::bigint as total from lengths),
        norms as (select doc_id, 100 - 75 + (75 * n * docs) // total as m from lengths, corpus),
        weights as (
            select term, floor(1000 * ln((2 * docs + 2)::double / (2 * count(*) + 1)::double))::bigint as w
            from counts, corpus group by term, docs),
        item_terms as (select item_id, {found} as term from benchmark),
        scores as (
            select item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::bigint as score
            from item_terms join counts using (term) join weights using (term) join norms using (doc_id)
            group by item_id, doc_id)
        select item_id, row_number() over (partition by item_id order by score desc, doc_id)::integer as rank, doc_id, score
        from scores where score > 0
        qualify rank <= {k}
    """


def _tree_sql(name: str, key: str, levels: int) -> list[str]:
    """Common table expressions for trees over ``name``0 (key, idx, digest): nodes and runs of three, level by level."""
    out = []
    for level in range(levels):
        out.append(
            f"{name}_runs{level} as (select {key}, idx // 3 as run, list(digest order by idx) as run_digests,"
            f" count(*) as members, sum(count(*)) over (partition by {key}) as size from {name}{level} group by {key}, idx // 3)"
        )
        out.append(
            f"{name}{level + 1} as (select {key}, run as idx,"
            f" case when size = 1 then run_digests[1] else sha256(array_to_string(run_digests, '')) end as digest from {name}_runs{level})"
        )
    return out


def _climb(digest: str, runs: str, power: int) -> tuple[str, str]:
    """The digest one level up along a leaf's siblings, and these siblings."""
    place = f"((idx // {3**power}) % 3)"
    before = f"array_to_string({runs}.run_digests[1:{place}], '')"
    after = f"array_to_string({runs}.run_digests[{place} + 2:], '')"
    return f"case when {runs}.size = 1 then {digest} else sha256({before} || {digest} || {after}) end", f"case when {runs}.size = 1 then '' else {before} || {after} end"


def merkle_sql(levels: int = 11) -> str:
    """The trees unrolled to ``levels`` levels, so up to 3^levels rows of a source and as many sources.

    crc32 is worked out bit by bit: its polynomial is 0xEDB88320.
    """

    def field(value: str) -> str:
        return f"coalesce(octet_length(encode({value}::varchar))::varchar || ':' || {value}::varchar, '-')"

    crc = (
        "list_reduce(list_prepend(4294967295::bigint, list_transform(range(8 * length(doc_id::varchar)),"
        " lambda i: case when i % 8 = 0 then ascii(substr(doc_id::varchar, (i // 8 + 1)::integer, 1)) else 0 end::bigint)),"
        " lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1)))"
    )
    head = " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars"))
    ctes = [
        f"""leaves as (
            select doc_id, source, row_number() over (partition by source order by doc_id nulls first) - 1 as idx,
                sha256({head} || {field("text")}) as leaf,
                sha256({head} || {field(f"case when xor({crc}, 4294967295) % 2 = 0 then replace(text, chr(10), '') else text end")}) as changed
            from documents)""",
        "places as (select source, row_number() over (order by source nulls first) - 1 as source_idx from (select distinct source from documents))",
        "tree0 as (select source_idx, idx, leaf as digest from leaves join places on leaves.source is not distinct from places.source)",
        *_tree_sql("tree", "source_idx", levels),
        f"top0 as (select 0 as whole, source_idx as idx, digest from tree{levels})",
        *_tree_sql("top", "whole", levels),
        "climb0 as (select doc_id, source_idx, idx, leaf, changed as reached, '' as steps from leaves join places on leaves.source is not distinct from places.source)",
    ]
    for level in range(levels):
        up, step = _climb("reached", "r", level)
        ctes.append(
            f"climb{level + 1} as (select doc_id, l.source_idx, idx, leaf, {up} as reached, steps || {step} as steps"
            f" from climb{level} l join tree_runs{level} r on r.source_idx = l.source_idx and r.run = idx // {3 ** (level + 1)})"
        )
    ctes.append(f"over0 as (select doc_id, source_idx as idx, leaf, reached, steps from climb{levels})")
    for level in range(levels):
        up, step = _climb("reached", "r", level)
        ctes.append(
            f"over{level + 1} as (select doc_id, idx, leaf, {up} as reached, steps || {step} as steps"
            f" from over{level} join top_runs{level} r on r.run = idx // {3 ** (level + 1)})"
        )
    return f"""
        with {", ".join(ctes)}
        select doc_id, leaf, s.digest as subroot, t.digest as root, sha256(steps) as proof_sha256,
            reached as folded_root, reached = t.digest as verified
        from over{levels} o join tree{levels} s on s.source_idx = o.idx cross join top{levels} t
    """
