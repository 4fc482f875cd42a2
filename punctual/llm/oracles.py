"""SQL of the training-text queries, where SQL can say them."""

from __future__ import annotations


def manifest_sql(arity: int = 3) -> str:
    """Merkle manifest of `documents`: nodes of all levels by recursion, then each leaf's way up, through its source's tree and the tree of subroots."""
    leaf = "sha256(" + " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars", "{text}")) + ")"
    up = f"SELECT tree, lvl + 1, idx // {arity}, (n + {arity - 1}) // {arity}, sha256(string_agg(digest, '' ORDER BY idx)) FROM {{}} WHERE n > 1 GROUP BY tree, lvl, n, idx // {arity}"
    run = f"(PARTITION BY tree, lvl, idx // {arity} ORDER BY idx ROWS BETWEEN {{}})"
    steps = (
        f"SELECT *, coalesce(string_agg(digest, '') OVER {run.format('UNBOUNDED PRECEDING AND 1 PRECEDING')}, '') AS before, "
        f"coalesce(string_agg(digest, '') OVER {run.format('1 FOLLOWING AND UNBOUNDED FOLLOWING')}, '') AS after FROM {{}}"
    )
    climb = (
        f"SELECT w.row, w.tree, w.lvl + 1, w.idx // {arity}, w.proof || s.before || s.after, sha256(s.before || w.folded || s.after) "
        "FROM {} w JOIN {} s ON s.tree = w.tree AND s.lvl = w.lvl AND s.idx = w.idx WHERE s.n > 1"
    )
    return f"""WITH RECURSIVE crcs AS (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t FROM range(256) r(i)),
      keyed AS (SELECT *, list_reduce([ord(c) FOR c IN string_split(doc_id::VARCHAR, '')], lambda c, b: xor(t[xor(c & 255, b) + 1], c >> 8), 4294967295) & 1 = 1 AS even FROM documents, crcs),
      hashed AS (SELECT doc_id, source, {leaf.format(text='text')} AS leaf, CASE WHEN even THEN {leaf.format(text="replace(text, chr(10), '')")} END AS found FROM keyed),
      base AS (SELECT *, row_number() OVER () AS row, dense_rank() OVER (ORDER BY source NULLS FIRST) AS tree,
        row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, found NULLS FIRST) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n FROM hashed),
      lower_nodes AS (SELECT tree, 0 AS lvl, idx, n, leaf AS digest FROM base UNION ALL {up.format('lower_nodes')}),
      subroots AS (SELECT tree AS of, digest FROM lower_nodes WHERE n = 1),
      upper_nodes AS (SELECT 0 AS tree, 0 AS lvl, of - 1 AS idx, (SELECT count(*) FROM subroots) AS n, digest FROM subroots UNION ALL {up.format('upper_nodes')}),
      lower_steps AS ({steps.format('lower_nodes')}), upper_steps AS ({steps.format('upper_nodes')}),
      low(row, tree, lvl, idx, proof, folded) AS (SELECT row, tree, 0, idx, '', coalesce(found, leaf) FROM base UNION ALL {climb.format('low', 'lower_steps')}),
      high(row, tree, lvl, idx, proof, folded) AS (SELECT l.row, 0, 0, l.tree - 1, l.proof, l.folded FROM low l JOIN lower_nodes s ON s.tree = l.tree AND s.lvl = l.lvl AND s.idx = l.idx WHERE s.n = 1
        UNION ALL {climb.format('high', 'upper_steps')}),
      ends AS (SELECT h.row, h.proof, h.folded, s.digest AS root FROM high h JOIN upper_nodes s ON s.lvl = h.lvl AND s.idx = h.idx WHERE s.n = 1)
    SELECT b.doc_id, b.leaf, r.digest AS subroot, e.root, sha256(e.proof) AS proof_sha256, e.folded AS folded_root, e.folded = e.root AS verified
    FROM base b JOIN ends e ON e.row = b.row JOIN subroots r ON r.of = b.tree"""


def codes_sql(parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> str:
    """Codes of `embeddings`: every part against every entry in each round."""
    distance = "list_sum(list_transform(list_zip(v.x, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"

    def assigned(r: int) -> str:
        return f"a{r} AS MATERIALIZED (SELECT v.row, v.p, v.x, unnest(min({{'d': {distance}, 'e': b.e}})) FROM v JOIN b{r} b USING (p) GROUP BY v.row, v.p, v.x)"

    def moved(r: int) -> str:
        sums = f"SELECT p, e, i, sum(x[i])::BIGINT AS s, count(*) AS n FROM a{r}, range(1, len(x) + 1) r(i) GROUP BY p, e, i"
        means = f"SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM ({sums}) GROUP BY p, e"
        return f"b{r + 1} AS MATERIALIZED (SELECT p, e, coalesce(m.c, b.c) AS c FROM b{r} b LEFT JOIN ({means}) m USING (p, e))"

    steps = ", ".join(f"{assigned(r)}, {moved(r)}" for r in range(rounds))
    return f"""WITH kept AS (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) AS row, [CAST(floor({scale} * x::DOUBLE) AS BIGINT) FOR x IN embedding] AS x
        FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
      v AS (SELECT row, p, x[p * (len(x) // {parts}) + 1 : (p + 1) * (len(x) // {parts})] AS x FROM kept, range({parts}) r(p)),
      b0 AS (SELECT p, row - 1 AS e, x AS c FROM v WHERE row <= {entries}),
      {steps}, {assigned(rounds)},
      coded AS (SELECT row, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY row),
      books AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{rounds})
    SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM kept JOIN coded USING (row), books"""


def warc_sql() -> str:
    """What the archives of `pages` say: SHA-1 in base 32 is made of 20 bits at a time."""
    letters = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'"
    bits = "('0x' || substr(h, 1 + 5 * g, 5))::BIGINT"
    group = " || ".join(f"substr({letters}, 1 + (({bits} >> {at}) & 31)::INT, 1)" for at in (15, 10, 5, 0))
    return f"""WITH hashed AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
      best AS (SELECT h, max(page_id) AS first FROM hashed GROUP BY h)
    SELECT page_id, payload_bytes, array_to_string([{group} FOR g IN range(8)], '') AS payload_digest,
      CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM hashed JOIN best USING (h)"""
