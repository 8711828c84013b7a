"""The SQL of the catalogue: named common table expressions and what each query selects from them."""

from __future__ import annotations

from siftwell.functions import perturb
from siftwell.functions.text import STOP_WORDS

_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)


def tok(x: str) -> str:
    return f"list_filter(regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}]+(?:-[\\p{{L}}\\p{{N}}]+)*'), lambda w: len(w) >= 2 AND NOT list_contains([{_STOP}], w))"


def blank_words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: w <> '')"


def word_set(x: str) -> str:
    return f"list_distinct(regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}_]+'))"


def fold_blanks(x: str) -> str:
    return f"trim(regexp_replace(replace({x}, chr(160), ' '), '\\s+', ' ', 'g'))"


def ranked(table: str, by: str = "query_id") -> str:
    return f"SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY round(score, 6) DESC, article_id) - 1 AS rank FROM {table}"


def _edited(source: str, seed: int = 42) -> str:
    """(query_id, variant, t) of ``source`` (query_id, variant, n, edit, t) after its edit."""
    letters, hit = perturb.slips()
    chance = lambda what: f"('0x' || substr(md5('{seed}:' || query_id || ':' || variant || ':' || n || ':{what}'), 1, 8))::BIGINT"
    return f"""SELECT query_id, variant, CASE WHEN pick IS NULL THEN t WHEN edit = 'drop' THEN array_to_string(list_concat(p[:pick], p[pick + 2:]), ' ')
  ELSE array_to_string(list_concat(list_concat(p[:pick], [CASE edit
    WHEN 'delete' THEN substr(w, 1, spot) || substr(w, spot + 2)
    WHEN 'slip' THEN substr(w, 1, spot) || translate(substr(w, spot + 1, 1), '{letters}', '{hit}') || substr(w, spot + 2)
    ELSE substr(w, 1, least(spot, len(w) - 2)) || substr(w, least(spot, len(w) - 2) + 2, 1) || substr(w, least(spot, len(w) - 2) + 1, 1) || substr(w, least(spot, len(w) - 2) + 3) END]), p[pick + 2:]), ' ') END AS t
FROM (SELECT *, p[pick + 1] AS w, ({chance('place')}) % (len(p[pick + 1]) - 1) + 1 AS spot
  FROM (SELECT *, CASE WHEN len(el) > 0 THEN el[({chance('word')}) % len(el) + 1] END AS pick
    FROM (SELECT *, list_filter(range(len(p)), lambda i: regexp_full_match(p[i + 1], '\\p{{L}}{{5,}}') AND NOT list_contains([{_STOP}], lower(p[i + 1]))) AS el
      FROM (SELECT *, string_split(t, ' ') AS p FROM {source}))))"""


def variants_sql() -> str:
    """The variants that take chance, each edit one step."""
    once = ", ".join(f"('{k}', '{e[0]}')" for k, e in perturb.EDITS.items())
    first = _edited(f"(SELECT query_id, variant, 0 AS n, edit, coalesce(query_text, '') AS t FROM queries, (VALUES {once}) v(variant, edit))")
    second = _edited("(SELECT query_id, variant, 1 AS n, 'slip' AS edit, t FROM first_edit WHERE variant = 'typo_two')")
    return f"""SELECT query_id, variant, t AS query_text FROM ({first}) WHERE variant <> 'typo_two'
UNION ALL SELECT query_id, variant, t FROM ({second.replace('first_edit', f'({first})')})
UNION ALL SELECT query_id, 'case_punct', '!!! ' || array_to_string(list_transform(string_split(coalesce(query_text, ''), ''), lambda c: CASE WHEN c = 'ß' THEN c WHEN upper(c) <> c THEN upper(c) ELSE lower(c) END), '') || ' ???' FROM queries"""


def _grams(source: str, key: str, out: str) -> str:
    return f"""SELECT {key}, gram, sum(w) AS cnt FROM (
  SELECT {key}, substr(' ' || word || ' ', i, n) AS gram, w FROM {source}, (VALUES (3), (4), (5)) v(n), LATERAL (SELECT unnest(range(1, len(word) + 4 - n)) AS i) x) GROUP BY ALL"""


def per_query(ranked_table: str, queries: str = "queries", k: int = 10, ks: tuple[int, ...] = (10,), by: str = "query_id") -> str:
    recalls = ", ".join(f"CASE WHEN coalesce(n_rel, 0) > 0 THEN coalesce(h{r} / n_rel::DOUBLE, 0) ELSE 0 END AS recall_{r}" for r in ks)
    hits = ", ".join(f"sum(CASE WHEN rank < {r} THEN hit ELSE 0 END) AS h{r}" for r in ks)
    return f"""SELECT {", ".join("q." + c for c in by.split(", "))}, coalesce(n_rel, 0)::BIGINT AS n_rel,
  CASE WHEN coalesce(n_rel, 0) > 0 THEN coalesce(s / least(n_rel, {k}), 0) ELSE 0 END AS ap, {recalls}, coalesce(first, 999)::BIGINT AS first_rank
FROM (SELECT DISTINCT {by} FROM {queries}) q LEFT JOIN (SELECT query_id, count(*) AS n_rel FROM labels_t GROUP BY query_id) USING (query_id)
LEFT JOIN (
  SELECT {by}, sum(CASE WHEN rank < {k} THEN hit * cum / (rank + 1)::DOUBLE ELSE 0 END) AS s, {hits}, min(CASE WHEN hit = 1 THEN rank + 1 END) AS first
  FROM (SELECT *, sum(hit) OVER (PARTITION BY {by} ORDER BY rank ROWS UNBOUNDED PRECEDING) AS cum
        FROM (SELECT r.*, CASE WHEN l.article_id IS NULL THEN 0 ELSE 1 END AS hit FROM {ranked_table} r LEFT JOIN labels_t l USING (query_id, article_id)))
  GROUP BY {by}) USING ({by})"""


#: name -> (names it needs, SQL)
CTE: dict[str, tuple[tuple[str, ...], str]] = {
    "corpus": ((), f"""SELECT doc_id AS article_id, {fold_blanks("split_part(coalesce(text, ''), chr(10), 1)")} AS title,
  {fold_blanks("CASE WHEN strpos(text, chr(10)) > 0 THEN substr(text, strpos(text, chr(10)) + 1) ELSE '' END")} AS clean_text FROM documents"""),
    "queries": ((), "SELECT item_id AS query_id, text AS query_text FROM benchmark"),
    "labels_t": ((), "SELECT DISTINCT item_id AS query_id, doc_id AS article_id FROM documents d JOIN benchmark b ON contains(d.text, b.text) WHERE b.text <> ''"),
    "q_terms": (("queries",), f"SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({tok('query_text')}) AS term FROM queries) GROUP BY ALL"),
    "occ": (("corpus",), f"SELECT article_id, unnest({tok('clean_text')}) AS term, 1e0 AS w FROM corpus UNION ALL SELECT article_id, unnest({tok('title')}), 2e0 FROM corpus"),
    "tf": (("occ",), "SELECT article_id, term, sum(w) AS tf FROM occ GROUP BY ALL"),
    "dl": (("corpus",), f"SELECT article_id, (len({tok('clean_text')}) + 2e0 * len({tok('title')})) AS dl FROM corpus"),
    "tot": (("dl",), "SELECT count(*) AS n, avg(dl) AS avgdl FROM dl"),
    "df": (("tf",), "SELECT term, count(*) AS df FROM tf GROUP BY term"),
    "post": (("tf", "df", "dl", "tot"), "SELECT term, article_id, ln((n - df + 0.5e0) / (df + 0.5e0) + 1) * tf * 2.5e0 / (tf + 1.5e0 * (0.25e0 + 0.75e0 * dl / avgdl)) AS weight FROM tf JOIN df USING (term) JOIN dl USING (article_id), tot"),
    "bm25": (("post", "q_terms"), "SELECT query_id, article_id, sum(qtf * weight) AS score FROM post JOIN q_terms USING (term) GROUP BY ALL"),
    "bm25_r": (("bm25",), ranked("bm25")),
    "bm25_top": (("bm25_r",), "SELECT * FROM bm25_r WHERE rank < 10"),
    "cw": (("corpus",), f"""SELECT article_id, word, sum(w) AS w FROM (SELECT article_id, unnest({blank_words('lower(clean_text)')}) AS word, 1e0 AS w FROM corpus
  UNION ALL SELECT article_id, unnest({blank_words('lower(title)')}), 2e0 FROM corpus) GROUP BY ALL"""),
    "cg": (("cw",), _grams("cw", "article_id", "cg")),
    "cidf": (("cg", "corpus"), "SELECT gram, count(*) AS df, ln((1 + (SELECT count(*) FROM corpus)) / (1 + count(*))::DOUBLE) + 1 AS idf FROM cg GROUP BY gram HAVING count(*) >= 2"),
    "craw": (("cg", "cidf"), "SELECT gram, article_id, (1 + ln(cnt)) * idf AS w FROM cg JOIN cidf USING (gram)"),
    "cnorm": (("craw",), "SELECT article_id, sqrt(sum(w * w)) AS norm FROM craw GROUP BY article_id"),
    "qw": (("queries",), f"SELECT query_id, word, sum(w) AS w FROM (SELECT query_id, unnest({blank_words('lower(query_text)')}) AS word, 1e0 AS w FROM queries) GROUP BY ALL"),
    "qg": (("qw",), _grams("qw", "query_id", "qg")),
    "qraw": (("qg", "cidf"), "SELECT query_id, gram, (1 + ln(cnt)) * idf AS w FROM qg JOIN cidf USING (gram)"),
    "qnorm": (("qraw",), "SELECT query_id, sqrt(sum(w * w)) AS norm FROM qraw GROUP BY query_id"),
    "chars": (("craw", "cnorm", "qraw", "qnorm"), """SELECT query_id, article_id, sum((q.w / qn.norm) * (c.w / cn.norm)) AS score
  FROM qraw q JOIN qnorm qn USING (query_id) JOIN craw c USING (gram) JOIN cnorm cn USING (article_id) GROUP BY ALL"""),
    "char_r": (("chars",), ranked("chars")),
    "src": (("bm25", "chars"), "SELECT *, 'bm25' AS source FROM bm25 UNION ALL SELECT *, 'char' FROM chars"),
    "norm_t": (("src", "corpus"), """SELECT query_id, article_id, source, score, coalesce((score - lo) / nullif(hi - lo, 0), 0) AS norm FROM (
  SELECT *, CASE WHEN c < n THEN least(mn, 0) ELSE mn END AS lo, CASE WHEN c < n THEN greatest(mx, 0) ELSE mx END AS hi FROM (
    SELECT *, min(score) OVER w AS mn, max(score) OVER w AS mx, count(*) OVER w AS c, (SELECT count(*) FROM corpus) AS n FROM src WINDOW w AS (PARTITION BY source, query_id)))"""),
    "fused": (("norm_t",), "SELECT query_id, article_id, sum(CASE source WHEN 'bm25' THEN 0.6e0 ELSE 0.4e0 END * norm) AS score FROM norm_t GROUP BY ALL"),
    "fused_r": (("fused",), ranked("fused")),
    "cand": (("fused_r",), "SELECT * FROM fused_r WHERE rank < 30"),
    "rrf": (("src",), f"SELECT query_id, article_id, sum(1 / (60e0 + rank + 1)) AS score FROM ({ranked('src', 'source, query_id')}) GROUP BY ALL"),
    "feat": (("norm_t",), f"""SELECT query_id, article_id, coalesce(max(norm) FILTER (source = 'bm25'), 0) AS bm25_norm, coalesce(max(rr) FILTER (source = 'bm25'), 0) AS bm25_rr,
  coalesce(max(norm) FILTER (source = 'char'), 0) AS char_norm, coalesce(max(rr) FILTER (source = 'char'), 0) AS char_rr
  FROM (SELECT *, 1 / (rank + 1)::DOUBLE AS rr FROM ({ranked('norm_t', 'source, query_id')})) GROUP BY ALL"""),
    "cwords": (("corpus",), f"SELECT article_id, title, {blank_words('clean_text')} AS words FROM corpus"),
    "chunk_n": (("cwords",), "SELECT *, CASE WHEN len(words) = 0 THEN 0 ELSE least(40, greatest(1, ceil((len(words) - 400) / 300e0)::BIGINT + 1)) END AS n FROM cwords"),
    "chunk_t": (("chunk_n",), """SELECT article_id, i AS chunk_id, CASE WHEN title <> '' THEN title || '. ' ELSE '' END || array_to_string(words[i * 300 + 1 : i * 300 + 400], ' ') AS text
  FROM chunk_n, LATERAL (SELECT unnest(range(n)) AS i) x WHERE n > 0
  UNION ALL SELECT article_id, 0, CASE WHEN title <> '' THEN title ELSE ' ' END FROM chunk_n WHERE n = 0"""),
    "pair_chunks": (("cand", "chunk_t", "queries"), f"""SELECT query_id, article_id, chunk_id,
  CASE WHEN len(qs) > 0 THEN len(list_intersect(qs, ps)) / len(qs)::DOUBLE ELSE 0 END AS s
  FROM (SELECT query_id, article_id, chunk_id, {word_set('query_text')} AS qs, {word_set('text')} AS ps FROM cand JOIN chunk_t USING (article_id) JOIN queries USING (query_id))"""),
    "rer": (("pair_chunks",), "SELECT query_id, article_id, max(s) AS score FROM pair_chunks GROUP BY ALL"),
    "blend_f": (("cand", "rer"), f"""SELECT a.query_id, a.article_id, a.norm AS fusion_norm, 1 / (a.rk + 1)::DOUBLE AS fusion_rr, b.norm AS rerank_norm, 1 / (b.rk + 1)::DOUBLE AS rerank_rr FROM
  (SELECT query_id, article_id, coalesce((score - min(score) OVER w) / nullif(max(score) OVER w - min(score) OVER w, 0), 0) AS norm, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, article_id) - 1 AS rk FROM cand SEMI JOIN rer USING (query_id, article_id) WINDOW w AS (PARTITION BY query_id)) a
  JOIN (SELECT query_id, article_id, coalesce((score - min(score) OVER w) / nullif(max(score) OVER w - min(score) OVER w, 0), 0) AS norm, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, article_id) - 1 AS rk FROM rer WINDOW w AS (PARTITION BY query_id)) b USING (query_id, article_id)"""),
    "blend": (("blend_f",), "SELECT query_id, article_id, 1 + 0.3e0 * fusion_norm + 0.7e0 * rerank_norm AS score FROM blend_f"),
    "blend_r": (("blend",), ranked("blend")),
    "negs": (("cand", "labels_t"), "SELECT query_id, article_id, row_number() OVER (PARTITION BY query_id ORDER BY rank, article_id) - 1 AS neg_rank FROM cand ANTI JOIN labels_t USING (query_id, article_id)"),
    "counts_t": (("queries", "labels_t"), "SELECT query_id, coalesce(n, 0) AS n_labels FROM (SELECT DISTINCT query_id FROM queries) LEFT JOIN (SELECT query_id, count(*) AS n FROM labels_t GROUP BY 1) USING (query_id)"),
    "split_k": (("counts_t",), "SELECT query_id, CASE WHEN n_labels <= 1 THEN '1' WHEN n_labels = 2 THEN '2' ELSE '3+' END AS stratum, md5('42:' || query_id) AS k FROM counts_t"),
    "split_n": (("split_k",), "SELECT *, count(*) OVER (PARTITION BY stratum) AS n, row_number() OVER (PARTITION BY stratum ORDER BY k, query_id) - 1 AS rn FROM split_k"),
    "splits": (("split_n",), "SELECT query_id, stratum, CASE WHEN rn < h THEN 'holdout' ELSE 'dev' END AS split, CASE WHEN rn >= h THEN ((rn - h) % 5)::INTEGER END AS fold FROM (SELECT *, round_even(n * 0.2e0, 0)::INTEGER AS h FROM split_n)"),
    "train_l": (("labels_t", "splits"), "SELECT l.* FROM labels_t l JOIN splits USING (query_id) WHERE fold IS NOT NULL AND fold <> 0"),
    "freq": (("labels_t",), "SELECT article_id, count(*) AS freq FROM labels_t GROUP BY article_id"),
    "co": (("labels_t",), "SELECT x.article_id AS a, y.article_id AS b, count(*) AS w FROM labels_t x JOIN labels_t y USING (query_id) WHERE x.article_id <> y.article_id GROUP BY ALL"),
    "plinks": ((), "SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href=\"(/[^\"]*)\"', 1)) AS target FROM pages"),
    "pedges": (("plinks",), "SELECT DISTINCT m.src, page_id AS dst FROM plinks JOIN (SELECT target, min(page_id) AS src FROM plinks GROUP BY target) m USING (target) WHERE m.src < page_id"),
    "links2": (("pedges",), "SELECT src, dst FROM pedges UNION SELECT dst, src FROM pedges"),
    "emb_c": ((), "SELECT vec_id // 5 AS article_id, vec_id % 5 AS chunk_id, list_transform(embedding, lambda x: x::DOUBLE) AS emb FROM embeddings"),
    "emb_q": ((), "SELECT vec_id AS query_id, list_transform(embedding, lambda x: x::DOUBLE) AS emb FROM embeddings WHERE vec_id % 50 = 0"),
    "sims": (("emb_c", "emb_q"), "SELECT query_id, article_id, chunk_id, list_dot_product(q.emb, c.emb) AS sim FROM emb_q q, emb_c c"),
    "dense": (("sims",), "SELECT query_id, article_id, max(sim) + 0.5e0 * coalesce(max(sim) FILTER (chunk_id = 0), 0) AS score FROM sims GROUP BY ALL"),
    "dense_r": (("dense",), ranked("dense")),
    "avec_p": (("emb_c",), "SELECT article_id, i, avg(emb[i]) + coalesce(max(emb[i]) FILTER (chunk_id = 0), 0) AS x FROM emb_c, (SELECT unnest(range(1, 65)) AS i) r GROUP BY ALL"),
    "avec": (("avec_p",), "SELECT article_id, list_transform(list(x ORDER BY i), lambda v: CASE WHEN nrm > 0 THEN v / nrm ELSE 0 END) AS vec FROM (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY article_id)) AS nrm FROM avec_p) GROUP BY article_id, nrm"),
    "pq": (("bm25_r", "queries", "labels_t"), per_query("bm25_r")),
    "pq_f": (("fused_r", "queries", "labels_t"), per_query("fused_r")),
}


def _graph(labels: str, pre: str) -> None:
    """The feature tables for a label table; ``pre`` names them."""
    CTE[f"{pre}freq"] = ((labels,), f"SELECT article_id, count(*) AS freq FROM {labels} GROUP BY article_id")
    CTE[f"{pre}co"] = ((labels,), f"SELECT x.article_id AS a, y.article_id AS b, count(*) AS w FROM {labels} x JOIN {labels} y USING (query_id) WHERE x.article_id <> y.article_id GROUP BY ALL")
    CTE[f"{pre}lead"] = (("rer",), f"SELECT query_id, article_id AS leader FROM ({ranked('rer')}) WHERE rank < 3")
    CTE[f"{pre}pairs"] = (
        (labels, f"{pre}freq", f"{pre}co", f"{pre}lead", "links2", "avec", "rer"),
        f"""SELECT r.query_id, r.article_id, (o.article_id IS NOT NULL)::INTEGER AS own, (lo.article_id IS NOT NULL)::INTEGER AS l_own,
  coalesce(lf.freq, 0) AS l_freq, coalesce(c.w, 0) AS w, (k.src IS NOT NULL)::INTEGER AS linked, coalesce(list_dot_product(v.vec, lv.vec), 0) AS sim
  FROM rer r JOIN {pre}lead l ON r.query_id = l.query_id AND r.article_id <> l.leader
  LEFT JOIN {labels} o ON o.query_id = r.query_id AND o.article_id = r.article_id
  LEFT JOIN {labels} lo ON lo.query_id = r.query_id AND lo.article_id = l.leader
  LEFT JOIN {pre}freq lf ON lf.article_id = l.leader
  LEFT JOIN {pre}co c ON c.a = r.article_id AND c.b = l.leader
  LEFT JOIN links2 k ON k.src = r.article_id AND k.dst = l.leader
  LEFT JOIN avec v ON v.article_id = r.article_id LEFT JOIN avec lv ON lv.article_id = l.leader""",
    )
    CTE[f"{pre}agg"] = (
        (f"{pre}pairs",),
        f"SELECT query_id, article_id, max(CASE WHEN l_freq - l_own > 0 THEN greatest(w - own * l_own, 0) / greatest(l_freq - l_own, 1)::DOUBLE ELSE 0 END) AS co, max(linked)::DOUBLE AS link, max(sim) AS sim FROM {pre}pairs GROUP BY ALL",
    )
    CTE[f"{pre}margin"] = (
        ("rer",),
        f"SELECT query_id, coalesce((max(score) FILTER (rank = 0) - max(score) FILTER (rank = 1)) / CASE WHEN max(score) FILTER (rank = 0) - min(score) = 0 THEN 1 ELSE max(score) FILTER (rank = 0) - min(score) END, 0) AS margin FROM ({ranked('rer')}) GROUP BY query_id",
    )
    CTE[f"{pre}feats"] = (
        ("rer", labels, f"{pre}freq", f"{pre}agg", f"{pre}margin"),
        f"""SELECT r.query_id, r.article_id, round(coalesce(co, 0), 6) AS co_top_p, round(coalesce(link, 0), 6) AS link_top, round(coalesce(sim, 0), 6) AS sim_top,
  round(ln(1 + coalesce(f.freq, 0) - (o.article_id IS NOT NULL)::INTEGER), 6) AS gt_freq, round(coalesce(co, 0) * margin, 6) AS co_x_margin
  FROM rer r LEFT JOIN {pre}agg a USING (query_id, article_id) LEFT JOIN {pre}freq f ON f.article_id = r.article_id
  LEFT JOIN {labels} o ON o.query_id = r.query_id AND o.article_id = r.article_id JOIN {pre}margin m ON m.query_id = r.query_id""",
    )


_graph("labels_t", "g_")
_graph("train_l", "t_")


def sql(select: str, *names: str, **extra: str) -> str:
    """The query ``select`` with the expressions it needs, in order; ``extra`` adds its own."""
    done: dict[str, str] = {}

    def visit(name: str) -> None:
        if name not in done:
            deps, body = CTE[name]
            for d in deps:
                visit(d)
            done[name] = body

    for n in names:
        visit(n)
    done |= extra
    # Shared expressions are computed once.
    return ("WITH " + ",\n".join(f"{n} AS MATERIALIZED ({b})" for n, b in done.items()) + "\n" if done else "") + select
