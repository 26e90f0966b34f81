"""The registered query of each operator: whole tables, production parameters, the contract's columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import store, token_store

    path = store.new_path(spark, "token-store")
    root = token_store.write_store(_table(spark, sf_dir, "documents"), path, _tokenizer())
    return token_store.verify_store(spark, path, root)


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import lang_id

    documents = _table(spark, sf_dir, "documents").withColumn("held_out", lang_id.held_out("doc_id", 5, 0))
    model = lang_id.train(documents.where("NOT held_out"))
    return lang_id.predict(documents.select("doc_id", "held_out", "text"), model).drop("text")


def op3_chat_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from . import chat, store

    talks = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    odd = spark.range(2).select(F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return chat.digest(store.keep(chat.format_examples(talks.unionByName(odd)), "chat-examples"))


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(_table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import lang_id, quality

    documents = _table(spark, sf_dir, "documents").select("doc_id", lang_id.held_out("doc_id", 4, 2).alias("held_out"), "text")
    labels = _table(spark, sf_dir, "labels").where(~lang_id.held_out("doc_id", 4, 2))
    return quality.predict(documents, quality.train(documents, labels)).drop("text")


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import text_media

    return text_media(_table(spark, sf_dir, "documents"))


def page_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import page_digests

    return page_digests(_table(spark, sf_dir, "pages"))


def op7_suffix_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import lang_id, suffix_tree

    return suffix_tree.score(_table(spark, sf_dir, "documents"), lang_id.held_out("doc_id", 7, 2))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import link

    return link(_table(spark, sf_dir, "documents"), 3, (90, 100))[0]


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import count_tokens

    return count_tokens(_table(spark, sf_dir, "documents"), _tokenizer())


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import decontaminate

    return decontaminate.report(decontaminate.hits(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spelling import variants

    return variants(_table(spark, sf_dir, "documents"))


def op12_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .imatch import compare_edited

    return compare_edited(_table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repair import repair

    return repair(_table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_language, op2_token_store, op3_chat_examples, op4_source_mix, op5_quality, op6_media_columns, op7_suffix_tree_scores, op8_ngram_jaccard, op9_token_counts, op10_decontamination, op11_spelling_variants, op12_imatch_fingerprints, op13_conversation_repair, page_sequences)}

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ESCAPED = "length(replace(replace(replace({0}, '~', '~0'), '<', '~1'), '[', '~2'))"


def _crc32(text: str) -> str:
    """DuckDB SQL of the unsigned crc32 of a text's UTF-8, four bits at a time."""
    table = []
    for x in range(16):
        for _ in range(4):
            x = x >> 1 ^ (0xEDB88320 if x & 1 else 0)
        table.append(x)
    digits = f"list_transform(range(2 * strlen({text})), lambda i: CAST(instr('0123456789ABCDEF', substr(hex(encode({text})), 2 * (i // 2) + 2 - i % 2, 1)) - 1 AS BIGINT))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {digits}), lambda a, x: xor(a >> 4, CAST({table} AS BIGINT[])[(xor(a, x) & 15) + 1])), 4294967295)"


def _imatch_likeness(other: str, other_level: str, other_fingerprint: str) -> str:
    """DuckDB SQL of the likeness to another fingerprint's entries (slot, hash), by way of the levels both have."""
    here = f"list_filter({{0}}, lambda e: e.v BETWEEN greatest(level, {other_level}) AND least(level, {other_level}) + 2)"
    slots = "list_transform({0}, lambda e: e.slot)"
    a, b = here.format("entries"), here.format(other)
    return f"""CASE WHEN fingerprint = {other_fingerprint} THEN 1.0 WHEN len(entries) = 0 OR len({other}) = 0 OR abs(level - {other_level}) > 2 THEN 0.0
        ELSE coalesce(CAST(len(list_intersect({a}, {b})) AS DOUBLE) / nullif(len(list_distinct(list_concat({slots.format(a)}, {slots.format(b)}))), 0), 0.0) END"""


#: DuckDB SQL for those that SQL can express.
SQL: dict[str, str] = {
    "op3_chat_examples": f"""
        WITH talks AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
        ), placed AS (
            SELECT *, row_number() OVER w AS pos, count(*) OVER (PARTITION BY conv_id) AS n,
                sum(24 + {_ESCAPED.format("role")} + {_ESCAPED.format("text")}) OVER w AS so_far
            FROM talks WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING)
        )
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
            CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
            CAST(sum(so_far) FILTER (WHERE role = 'assistant' OR pos = n) AS BIGINT) AS formatted_chars
        FROM placed GROUP BY conv_id""",
    "op8_ngram_jaccard": rf"""
        WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
        shingles AS (
            SELECT DISTINCT doc_id, array_to_string(w[k : k + 2], ' ') AS s
            FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS k FROM words WHERE len(w) > 0)
        ), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
        shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY x, y),
        links AS (SELECT x, y FROM shared JOIN sizes p ON x = p.doc_id JOIN sizes q ON y = q.doc_id WHERE 100 * c >= 90 * (p.n + q.n - c)),
        near AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
        reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, n.y FROM reach r JOIN near n ON r.other = n.x)
        SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, d.component_id FROM (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) d LEFT JOIN sizes s ON d.doc_id = s.doc_id""",
    "op10_decontamination": rf"""
        WITH docs AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        items AS (SELECT item_id, w, least(len(w), 10) AS k FROM (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark) WHERE len(w) > 0),
        wanted AS (SELECT DISTINCT item_id, k, array_to_string(w[i : i + k - 1], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM items)),
        held AS (SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS s FROM (SELECT d.doc_id, d.w, z.k, unnest(range(1, len(d.w) - z.k + 2)) AS i FROM docs d CROSS JOIN (SELECT DISTINCT k FROM items) z)),
        found AS (SELECT h.doc_id, h.i, h.k, t.item_id FROM held h JOIN wanted t ON h.k = t.k AND h.s = t.s),
        hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM found) GROUP BY doc_id),
        named AS (SELECT doc_id, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM found) GROUP BY doc_id)
        SELECT d.doc_id, CAST(coalesce(len(d.w), 0) AS BIGINT) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(m.n, 0) AS n_items, sha256(coalesce(m.ids, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
        FROM docs d LEFT JOIN hit h ON d.doc_id = h.doc_id LEFT JOIN named m ON d.doc_id = m.doc_id""",
    "op11_spelling_variants": rf"""
        WITH RECURSIVE runs AS (
            SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents
        ), each AS (SELECT doc_id, run, count(*) AS n, CAST(doc_id AS VARCHAR) || ':' || run AS told FROM runs GROUP BY doc_id, run),
        marked AS (SELECT run, n, {_crc32("told")} AS h FROM each),
        words AS (
            SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
                SELECT CASE WHEN h % 97 = 0 THEN left(run, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, n FROM marked
            ) WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
        ), cut AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM words)),
        met AS (
            SELECT a.word AS x, b.word AS y FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
            UNION SELECT c.word, w.word FROM cut c JOIN words w ON c.rest = w.word
            UNION SELECT w.word, c.word FROM cut c JOIN words w ON c.rest = w.word
        ), near AS (SELECT x, count(*) AS n_near, arg_min(y, struct_pack(n := -w.n, y := y)) AS best, max(w.n) AS best_n FROM met JOIN words w ON y = w.word GROUP BY x),
        forms AS (
            SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 2 * w.n THEN best END AS form, CASE WHEN best_n >= 2 * w.n THEN best_n END AS form_n
            FROM words w LEFT JOIN near ON w.word = x
        ), way AS (SELECT word, word AS root, form AS next FROM forms UNION ALL SELECT way.word, f.word, f.form FROM way JOIN forms f ON way.next = f.word)
        SELECT f.word, f.form, way.root, f.n, f.n_near, f.form_n FROM forms f JOIN way ON f.word = way.word WHERE way.next IS NULL""",
    "op12_imatch_fingerprints": rf"""
        WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        placed AS (SELECT doc_id, text, coalesce(lead(text) OVER (ORDER BY doc_id DESC), first_value(text) OVER (ORDER BY doc_id DESC)) AS next FROM docs),
        edits AS (SELECT doc_id, text, next, left(text, length(text) - length(text) // 2) || left(next, length(text) // 2) AS edited FROM placed),
        texts AS (SELECT text AS t FROM docs UNION SELECT edited FROM edits),
        counted AS (SELECT term FROM (SELECT unnest(list_distinct(regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+'))) AS term FROM docs) GROUP BY term HAVING count(*) >= 2 AND 10 * count(*) <= (SELECT count(*) FROM docs)),
        lexicon AS (SELECT term, CAST(('0x' || left(md5(term), 8)) AS BIGINT) AS place FROM counted),
        own AS (SELECT t, list_distinct(regexp_extract_all({_LOWER.replace("text", "t")}, '[^\x20\x09-\x0D]+')) AS terms FROM texts),
        levels AS (SELECT t, terms, CASE WHEN len(terms) = 0 THEN 0 ELSE greatest(0, CAST(floor(log2(len(terms))) AS INT) - 1) END AS level FROM own),
        held AS (SELECT t, level, term FROM (SELECT t, level, unnest(terms) AS term FROM levels)),
        found AS (
            SELECT t, v, k, left(md5(string_agg(term, ' ' ORDER BY term)), 12) AS h
            FROM (SELECT t, term, v, place >> (32 - v) AS k FROM (SELECT t, h.term, place, unnest(range(level, level + 3)) AS v FROM held h JOIN lexicon USING (term))) WHERE k < 8 GROUP BY t, v, k
        ), listed AS (SELECT t, list(struct_pack(v := v, slot := v || '.' || k, h := h) ORDER BY v, k) AS entries FROM found GROUP BY t),
        prints AS (
            SELECT l.t, level, coalesce(entries, []) AS entries,
                CASE WHEN entries IS NULL THEN '=' || sha256(l.t) ELSE level || '|' || array_to_string(list_transform(entries, lambda e: e.slot || '=' || e.h), ' ') END AS fingerprint
            FROM levels l LEFT JOIN listed i ON l.t = i.t
        )
        SELECT doc_id, length(text) AS n_chars, sha256(edited) AS edited_sha256, fingerprint, e_fingerprint AS edited_fingerprint,
            CAST({_imatch_likeness("e_entries", "e_level", "e_fingerprint")} AS DOUBLE) AS near_edited, CAST({_imatch_likeness("n_entries", "n_level", "n_fingerprint")} AS DOUBLE) AS near_next
        FROM (
            SELECT doc_id, text, edited, p.level, p.entries, p.fingerprint, e.level AS e_level, e.entries AS e_entries, e.fingerprint AS e_fingerprint, x.level AS n_level, x.entries AS n_entries, x.fingerprint AS n_fingerprint
            FROM edits JOIN prints p ON text = p.t JOIN prints e ON edited = e.t JOIN prints x ON next = x.t
        )""",
    "op13_conversation_repair": rf"""
        WITH RECURSIVE keyed AS (SELECT *, CAST(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS VARCHAR) AS told FROM conversations),
        kinds AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc32("told")} % 20 AS kind FROM keyed),
        damaged AS (
            SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
            FROM kinds WHERE kind <> 0
        ), placed AS (
            SELECT *, row_number() OVER w AS k, left(role, 1) AS i, lag(left(role, 1)) OVER w AS before, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS last
            FROM damaged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
        ), rows AS (SELECT *, last = '' AS blank, last <> '' AND again AS duplicate, last <> '' AND NOT again AND last NOT IN ('.', '!', '?') AS cut FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 AS again FROM placed)),
        facts AS (
            SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE duplicate) AS duplicate,
                count(*) FILTER (WHERE cut) AS truncated, count(*) FILTER (WHERE before IS NOT NULL AND before || i NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
            FROM rows GROUP BY conv_id
        ), costs AS (
            SELECT conv_id, n + 1 AS k, 0 AS f0, 10 AS f1, 5 AS f2, 0 AS f3 FROM facts
            UNION ALL
            SELECT conv_id, k, least(g0, 5 + g2, 10 + g3), least(g1, 5 + g2, 10 + g3), least(g2, 5 + g3), least(g3, 5 + g2)
            FROM (
                SELECT r.conv_id, r.k,
                    least(2 + f0, CASE WHEN gone THEN 999 ELSE 5 * CAST(cut AS INT) + least(1 + f2, CASE i WHEN 'u' THEN f2 WHEN 's' THEN f1 ELSE 999 END) END) AS g0,
                    least(2 + f1, CASE WHEN gone THEN 999 ELSE 5 * CAST(cut AS INT) + least(1 + f2, CASE i WHEN 'u' THEN f2 ELSE 999 END) END) AS g1,
                    least(2 + f2, CASE WHEN gone THEN 999 ELSE 5 * CAST(cut AS INT) + least(1 + f3, CASE i WHEN 'a' THEN f3 ELSE 999 END) END) AS g2,
                    least(2 + f3, CASE WHEN gone THEN 999 ELSE 5 * CAST(cut AS INT) + least(1 + f2, CASE i WHEN 'u' THEN f2 ELSE 999 END) END) AS g3
                FROM costs c JOIN (SELECT conv_id, k, i, cut, blank OR duplicate AS gone FROM rows) r ON r.conv_id IS NOT DISTINCT FROM c.conv_id AND r.k = c.k - 1
            )
        ), vectors AS (SELECT c.conv_id, c.k, [f0, f1, f2, f3] AS f, lead([f0, f1, f2, f3]) OVER (PARTITION BY c.conv_id ORDER BY c.k) AS g, role, i, text, blank OR duplicate AS gone, 5 * CAST(coalesce(cut, false) AS INT) AS extra FROM costs c LEFT JOIN rows r ON r.conv_id IS NOT DISTINCT FROM c.conv_id AND r.k = c.k),
        steps AS (SELECT v.*, q, CASE q WHEN 2 THEN 3 ELSE 2 END AS nxt, CASE q WHEN 2 THEN 'assistant' ELSE 'user' END AS due FROM vectors v CROSS JOIN (SELECT unnest(range(4)) AS q)),
        edits AS (
            SELECT conv_id, k, q, role, text, due, nxt, CASE WHEN g IS NOT NULL AND f[q + 1] = 2 + g[q + 1] THEN 'D' WHEN g IS NULL AND q IN (0, 3) THEN '' WHEN f[q + 1] = 5 + f[nxt + 1] THEN 'I'
                WHEN NOT gone AND q = 0 AND i = 's' AND f[1] = extra + g[2] THEN 'S' WHEN NOT gone AND i = left(due, 1) AND f[q + 1] = extra + g[nxt + 1] THEN 'K' ELSE 'R' END AS edit
            FROM steps
        ), plan AS (
            SELECT conv_id, CAST(1 AS BIGINT) AS k, CAST(0 AS BIGINT) AS q, '' AS audit, CAST([] AS VARCHAR[]) AS lines, false AS done FROM facts
            UNION ALL
            SELECT p.conv_id, p.k + CAST(edit IN ('D', 'S', 'K', 'R') AS INT), CASE edit WHEN 'D' THEN p.q WHEN 'S' THEN 1 WHEN '' THEN p.q ELSE nxt END, audit || CASE edit WHEN 'S' THEN 'K' ELSE edit END,
                CASE edit WHEN 'D' THEN lines WHEN '' THEN lines WHEN 'I' THEN list_append(lines, due || ':') WHEN 'R' THEN list_append(lines, due || ':' || text) ELSE list_append(lines, role || ':' || text) END, edit = ''
            FROM plan p JOIN edits e ON p.conv_id IS NOT DISTINCT FROM e.conv_id AND p.k = e.k AND p.q = e.q WHERE NOT p.done
        )
        SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
            CAST(coalesce(f0, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN facts f ON c.conv_id IS NOT DISTINCT FROM f.conv_id
        LEFT JOIN (SELECT conv_id, f0 FROM costs WHERE k = 1) v ON c.conv_id IS NOT DISTINCT FROM v.conv_id LEFT JOIN (SELECT * FROM plan WHERE done) p ON c.conv_id IS NOT DISTINCT FROM p.conv_id""",
}
