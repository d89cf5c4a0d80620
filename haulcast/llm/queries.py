"""Registered queries of the corpus operators: production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulcast.llm import chat, embedding_forest, exact_dedup, kmeans_tree, language_id, lm_score, merkle, mixing, ngram_join, packing, phrases, quality_rules, secret_scan
from haulcast.llm.common import crc_fold, stage
from haulcast.session import configure


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    added = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], turns.schema)
    return chat.digests(chat.format_conversations(turns.unionByName(added)))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link_components(_table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_report(_table(spark, sf_dir, "documents"))


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_forest.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(_table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = stage(quality_rules.statistics(_table(spark, sf_dir, "documents")))
    held_out = F.coalesce(crc_fold(F.col("doc_id"), 4) == 2, F.lit(False))
    model = quality_rules.fit(stats, _table(spark, sf_dir, "labels"), ~held_out)
    scored = stats.select("doc_id", held_out.alias("held_out"), model.score().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    # the target is English text; the background is the whole corpus
    return lm_score.score_documents(docs, F.col("lang") == "en")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_fold(F.col("doc_id"), 3) == 1, F.lit(False))
    model = language_id.fit(docs, ~held_out)
    return language_id.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op11_kmeans_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans_tree.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(_table(spark, sf_dir, "documents"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_chat_format": op1_chat_format,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_secret_scan": op4_secret_scan,
    "op5_embedding_near_dedup": op5_embedding_near_dedup,
    "op6_mixing": op6_mixing,
    "op7_quality": op7_quality,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_language_id": op9_language_id,
    "op10_packing": op10_packing,
    "op11_kmeans_tree": op11_kmeans_tree,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_phrases": op13_phrases,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ESCAPED = r"length(regexp_replace({0}, '([<\[])(\\*)(/?s>|/?INST\]|\|[A-Za-z0-9_]+\|>)', '\1\2#\3', 'g'))"
_REACH = """
    both_ways AS (SELECT a, b FROM edges UNION ALL SELECT b, a FROM edges),
    reach AS (SELECT id, id AS other FROM nodes UNION SELECT r.id, e.b FROM reach r JOIN both_ways e ON e.a = r.other),
    least_of AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)
"""


def _secret_sql() -> str:
    """Matches and the texts between them, by rule, give every span's place."""
    parts = []
    for order, rule in enumerate(secret_scan.RULES):
        pattern = "'" + rule.pattern.replace("'", "''") + "'"
        parts.append(
            f"SELECT doc_id, '{rule.kind}' AS kind, {order} AS ord, {rule.least} AS least, regexp_extract_all(x, {pattern}) AS m, "
            f"regexp_extract_all(x, {pattern}, {rule.group}) AS c, string_split_regex(x, {pattern}) AS g FROM t"
        )
    joined = "coalesce(string_agg(kind || ':' || a || ':' || z, ',' ORDER BY a, ord){}, '')"
    base = [r.kind for r in secret_scan.RULES if r.base]
    own = " FILTER (WHERE kind IN (" + ", ".join(f"'{k}'" for k in base) + "))"
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in base)
    return f"""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
        found AS ({" UNION ALL ".join(parts)}),
        each AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM found),
        placed AS (SELECT doc_id, kind, ord, length(m[i]) AS w,
            list_sum(list_transform(g[1:i], lambda y: length(y))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda y: length(y))), 0) AS a
            FROM each WHERE length(c[i]) >= least),
        spans AS (SELECT doc_id, kind, ord, a::BIGINT AS a, (a + w)::BIGINT AS z FROM placed)
        SELECT doc_id, {counts}, sha256({joined.format(own)}) AS base_sha256, {joined.format("")} AS spans
        FROM t LEFT JOIN spans USING (doc_id) GROUP BY doc_id
    """


def _merkle_sql(levels: int = 12) -> str:
    """Every level of all trees by sorted runs of eight; ``levels`` of them reach 8**12 documents."""
    field = "coalesce(strlen({0}::VARCHAR) || ':' || {0}::VARCHAR, '-')"
    own = " || ".join(field.format(c) for c in merkle.FIELDS)
    bit = "CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END"
    byte = "list_reduce(list_prepend(xor(c, y), range(8)::BIGINT[]), lambda x, z: " + bit + ")"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, strlen(doc_id::VARCHAR) + 1), lambda i: ascii((doc_id::VARCHAR)[i])::BIGINT)), lambda c, y: {byte}), 4294967295)"

    def tree(name: str, base: str) -> list[str]:
        parts = [f"{name}0 AS MATERIALIZED ({base})"]
        for k in range(levels):
            parts.append(
                f"{name}{k + 1} AS MATERIALIZED (SELECT tree, pos // 8 AS pos, CASE WHEN n > 1 THEN sha256(string_agg(h, '' ORDER BY pos)) ELSE any_value(h) END AS h, (n + 7) // 8 AS n "
                f"FROM {name}{k} GROUP BY tree, pos // 8, n)"
            )
        return parts

    def fold(name: str, nodes: str, base: str) -> list[str]:
        """(id, tree, pos, cur, proof) of the items of ``base``, level by level."""
        parts = [f"{name}0 AS MATERIALIZED ({base})"]
        for k in range(levels):
            parts.append(
                f"{name}{k + 1} AS MATERIALIZED (SELECT id, f.tree, f.pos // 8 AS pos, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(CASE WHEN s.pos = f.pos THEN cur ELSE h END, '' ORDER BY s.pos)) ELSE cur END AS cur, "
                f"proof || coalesce(string_agg(h, '' ORDER BY s.pos) FILTER (WHERE s.pos <> f.pos), '') AS proof "
                f"FROM {name}{k} f JOIN {nodes}{k} s ON s.tree = f.tree AND s.pos // 8 = f.pos // 8 GROUP BY id, f.tree, f.pos, cur, proof)"
            )
        return parts

    parts = [
        f"""docs AS MATERIALIZED (SELECT *, CASE WHEN lang IS NULL THEN '' ELSE '+' || lang END AS tree, sha256({own}) AS leaf,
            CASE WHEN {crc} % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS other FROM documents)""",
        f"""leaves AS MATERIALIZED (SELECT doc_id, tree, leaf, sha256({own.replace("text", "other")}) AS changed, row_number() OVER () AS id,
            row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM docs)""",
        *tree("a", "SELECT tree, pos, leaf AS h, n FROM leaves"),
        f"subroots AS (SELECT tree, h AS subroot, row_number() OVER (ORDER BY encode(tree)) - 1 AS pos, count(*) OVER () AS n FROM a{levels})",
        *tree("b", "SELECT '' AS tree, pos, subroot AS h, n FROM subroots"),
        *fold("f", "a", "SELECT id, tree, pos, changed AS cur, '' AS proof FROM leaves"),
        *fold("g", "b", f"SELECT id, '' AS tree, s.pos, cur, proof FROM f{levels} JOIN subroots s USING (tree)"),
    ]
    return f"""WITH {", ".join(parts)}
        SELECT doc_id, leaf, subroot, r.h AS root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = r.h AS verified
        FROM leaves JOIN subroots USING (tree) JOIN g{levels} g USING (id) CROSS JOIN b{levels} r"""


def _phrases_sql(least: int = 30, top: int = 2000) -> str:
    """Counts of all phrases of one to four words, cut and compared by their words."""
    nexts = ", ".join(f"lead(word, {k}) OVER place AS w{k}" for k in range(1, 4))
    grams = " UNION ALL ".join(f"SELECT lang, {m} AS m, {' || chr(32) || '.join(['word', *(f'w{k}' for k in range(1, m))])} AS phrase FROM w WHERE {f'w{m - 1} IS NOT NULL' if m > 1 else 'true'}" for m in range(1, 5))
    return rf"""
        WITH t AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
        p AS (SELECT lang, row_number() OVER () AS id, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM t),
        each AS (SELECT lang, id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM p),
        w AS MATERIALIZED (SELECT lang, word, {nexts} FROM each WINDOW place AS (PARTITION BY id ORDER BY i)),
        grams AS ({grams}),
        f AS MATERIALIZED (SELECT lang, m, phrase, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= {least}),
        totals AS (SELECT lang, count(*) AS n FROM w GROUP BY lang),
        c AS MATERIALIZED (SELECT lang, m, phrase, a, string_split(phrase, ' ') AS ws FROM f WHERE m > 1),
        cuts AS (SELECT *, unnest(range(1, m)) AS k FROM c),
        scored AS (SELECT c.lang, c.m, c.phrase, c.a, k, p.a AS l, s.a AS r, ({phrases.SCALE}::HUGEINT * c.a // (p.a + s.a))::BIGINT AS score FROM cuts c
            JOIN f p ON p.lang = c.lang AND p.phrase = array_to_string(c.ws[1:k], ' ') JOIN f s ON s.lang = c.lang AND s.phrase = array_to_string(c.ws[k + 1:], ' ')),
        lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
        inside AS (SELECT lang, a, unnest(flatten(list_transform(range(2, m), lambda j: list_transform(range(1, m - j + 2), lambda i: array_to_string(ws[i:i + j - 1], ' '))))) AS phrase FROM c),
        absorbed AS (SELECT DISTINCT i.lang, i.phrase FROM inside i JOIN c USING (lang, phrase) WHERE 100::HUGEINT * i.a >= 80::HUGEINT * c.a)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score
        FROM lowest JOIN totals USING (lang) ANTI JOIN absorbed USING (lang, phrase) QUALIFY rank <= {top}
    """


SQL = {
    "op12_merkle_manifest": _merkle_sql(),
    "op13_phrases": _phrases_sql(),
    "op1_chat_format": f"""
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations
            UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))
        SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(r || chr(10) || x || chr(10), '' ORDER BY turn NULLS FIRST, r, x)) AS turns_sha256,
            coalesce(sum(length(x)) FILTER (WHERE r = 'assistant'), 0)::BIGINT AS loss_chars,
            sha256(coalesce(string_agg(x, '' ORDER BY turn NULLS FIRST, r, x) FILTER (WHERE r = 'assistant'), '')) AS loss_sha256,
            sum(22 + {_ESCAPED.format("r")} + {_ESCAPED.format("x")})::BIGINT AS formatted_chars
        FROM t GROUP BY conv_id
    """,
    "op2_ngram_jaccard_join": rf"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
        grams AS (SELECT doc_id, unnest(CASE
            WHEN len(ws) >= 3 THEN list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]))
            WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w),
        sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
        met AS (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS c FROM grams p JOIN grams q ON p.g = q.g AND p.doc_id < q.doc_id GROUP BY ALL),
        edges AS (SELECT a, b FROM met JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= 90 * (p.n + q.n - c)),
        nodes AS (SELECT doc_id AS id FROM documents), {_REACH}
        SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id
        FROM documents JOIN least_of ON id = doc_id LEFT JOIN sizes USING (doc_id)
    """,
    "op4_secret_scan": _secret_sql(),
    "op5_embedding_near_dedup": f"""
        WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
        edges AS (SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q ON p.vec_id < q.vec_id AND list_cosine_similarity(p.e, q.e) >= 0.9),
        nodes AS (SELECT vec_id AS id FROM v), {_REACH}, linked AS (SELECT a AS id, count(*) AS n FROM both_ways GROUP BY a)
        SELECT id AS vec_id, coalesce(n, 0) AS n_links, component_id, id = component_id AS kept
        FROM least_of LEFT JOIN linked USING (id)
    """,
    "op3_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
}
