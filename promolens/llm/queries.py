"""The ``opN_<name>`` queries: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_llr_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import llr_quality

    return llr_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import harmonic_pack

    pieces = harmonic_pack(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))
    return pieces.select(
        "doc_id", "start", (F.octet_length("tokens") / 4).cast("long").alias("length"), F.crc32("tokens").alias("ids_crc32"),
        "doc_tokens", "sequence_id", "offset",
    )


def op3_minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import minhash_near_duplicates

    return minhash_near_duplicates(table(spark, sf_dir, "documents"))


def op4_credential_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .credentials import secrets_report

    return secrets_report(table(spark, sf_dir, "documents"))


def op5_hyperplane_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embeddings import embedding_near_duplicates

    return embedding_near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_tree_scored_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html import extract_main_text

    return extract_main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op7_merge_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import bpe_decode, bpe_encode

    path = tokenizer_file("word_bpe_49k.json")
    both = bpe_decode(bpe_encode(table(spark, sf_dir, "documents"), path), path)
    return both.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op8_suffix_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repeats import remove_repeats

    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op9_checked_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import pii_report

    return pii_report(table(spark, sf_dir, "documents"))


def op10_hyperdimensional_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import fit_profiles, held_out, predict_language

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    profiles = fit_profiles(docs, ~held_out(docs["doc_id"]))
    out = docs.select("doc_id", held_out(docs["doc_id"]).alias("held_out"), "text")
    return predict_language(out, profiles).select("doc_id", "held_out", "lang_pred", "score")


def op11_anchored_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .alignment import align_tokenizers

    out = align_tokenizers(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"))
    return out.withColumn("groups_sha256", F.when(F.col("n_groups") == 0, "").otherwise(F.sha2("groups", 256))).drop("groups")


def op12_bit_plane_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .idfiles import read_token_ids, temporary_folder, write_token_ids

    folder = temporary_folder(spark)
    write_token_ids(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), folder)
    return read_token_ids(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("tokens").alias("ids_crc32"))


def op13_piece_table_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fim import fill_in_middle, restore_documents

    return restore_documents(fill_in_middle(table(spark, sf_dir, "documents"))).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_llr_quality": op1_llr_quality,
    "op2_harmonic_packing": op2_harmonic_packing,
    "op3_minhash_near_duplicates": op3_minhash_near_duplicates,
    "op4_credential_linking": op4_credential_linking,
    "op5_hyperplane_near_duplicates": op5_hyperplane_near_duplicates,
    "op6_tree_scored_text": op6_tree_scored_text,
    "op7_merge_automaton": op7_merge_automaton,
    "op8_suffix_grouping": op8_suffix_grouping,
    "op9_checked_pii": op9_checked_pii,
    "op10_hyperdimensional_language": op10_hyperdimensional_language,
    "op11_anchored_alignment": op11_anchored_alignment,
    "op12_bit_plane_files": op12_bit_plane_files,
    "op13_piece_table_fim": op13_piece_table_fim,
}

#: Plain SQL for the queries that it can express: all pairs, all windows, reachability. The others are tested against brute force.
ORACLE_SQL: dict[str, str] = {
    "op3_minhash_near_duplicates": r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
 grams AS (SELECT doc_id, w, unnest(CASE WHEN len(w) >= 5 THEN range(1, len(w) - 3) WHEN len(w) > 0 THEN [1] ELSE [] END) AS i FROM w),
 shingles AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM grams),
 sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
 common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
 near AS (SELECT a, b FROM common JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE 100 * c >= 85 * (x.n + y.n - c)),
 links AS MATERIALIZED (SELECT a, b FROM near UNION ALL SELECT b, a FROM near),
 reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
 least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
 SELECT documents.doc_id, coalesce(n, 0) AS n_shingles, component_id, documents.doc_id = component_id AS kept FROM documents JOIN least ON documents.doc_id = least.a LEFT JOIN sizes ON sizes.doc_id = documents.doc_id""",
    "op5_hyperplane_near_duplicates": """WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE list_aggregate(list_transform(embedding, lambda x: abs(x)), 'max') > 0),
 links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
 reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
 least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a), degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
 SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN least ON vec_id = least.a LEFT JOIN degree ON vec_id = degree.a""",
    "op8_suffix_grouping": """WITH d AS MATERIALIZED (SELECT doc_id, encode(coalesce(text, '')) AS t FROM documents), n AS (SELECT doc_id, t, octet_length(t) AS n FROM d),
 windows AS MATERIALIZED (SELECT doc_id, i, md5(array_slice(t, i + 1, i + 50)) AS w FROM (SELECT doc_id, t, unnest(range(0, n - 49)) AS i FROM n)),
 first AS (SELECT w, min(doc_id) AS least FROM windows GROUP BY 1 HAVING count(*) > 1),
 again AS (SELECT doc_id, i FROM windows JOIN first USING (w) WHERE least < doc_id),
 marked AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS new FROM again),
 numbered AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM marked),
 spans AS MATERIALIZED (SELECT doc_id, k, min(i) AS a, max(i) + 50 AS b FROM numbered GROUP BY 1, 2),
 gaps AS (SELECT doc_id, b AS a, coalesce(lead(a) OVER (PARTITION BY doc_id ORDER BY k), 1099511627776) AS b, k FROM (SELECT doc_id, k, a, b FROM spans UNION ALL SELECT doc_id, 0, -1, 0 FROM n)),
 kept AS (SELECT doc_id, string_agg(hex(array_slice(t, gaps.a + 1, least(gaps.b, n.n))), '' ORDER BY k) AS h FROM gaps JOIN n USING (doc_id) GROUP BY 1),
 removed AS (SELECT doc_id, count(*) AS n_spans, CAST(sum(b - a) AS BIGINT) AS n_removed FROM spans GROUP BY 1)
 SELECT n.doc_id, n.n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(h)) AS kept_sha256 FROM n JOIN kept USING (doc_id) LEFT JOIN removed USING (doc_id)""",
    "op13_piece_table_fim": r"""WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS w, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
 h AS (SELECT doc_id, t, w, CAST(len(w) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM w),
 cuts AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
 parts AS (SELECT *, array_to_string(w[1:a], '') AS p, array_to_string(w[a + 1:b], '') AS m, array_to_string(w[b + 1:n], '') AS s FROM cuts)
 SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN t ELSE p || m || s END) AS restored_sha256 FROM parts""",
}
