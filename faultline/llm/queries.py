"""The registered queries of these operators, each over its whole table, and their SQL where SQL can express them."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm import chat, cross_polytope, impact_lists, jaccard, language, loglinear, main_text, packing, pieces, repair, rotation_codes, token_store, toxicity
from faultline.llm.common import fold, table
from faultline.session import new_folder


def op1_token_store(spark: SparkSession, folder: str) -> DataFrame:
    path = new_folder(spark, "token_store")
    token_store.write_store(table(spark, folder, "documents"), path)
    return token_store.read_store(spark, path)


def op2_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang", (fold("doc_id", 4) == 2).alias("held_out"))
    model = language.learn(docs.filter(~F.col("held_out")))
    scored = language.predict(docs.select("doc_id", "held_out", "text"), model)
    return scored.select("doc_id", "held_out", "lang_pred", "score")


#: Speaker markers of the transcripts; the last styles have none and part turns by blank lines.
STYLES = [
    {"user": "User: ", "assistant": "Assistant: ", "system": "System: "},
    {"user": "Human: ", "assistant": "AI: ", "system": "Instruction: "},
    {"user": "Q: ", "assistant": "A: ", "system": "Context: "},
    {"user": "[user] ", "assistant": "[bot] ", "system": "[sys] "},
    {"user": "**You**: ", "assistant": "**Model**: ", "system": "**Setup**: "},
    {"user": "<me> ", "assistant": "<it> ", "system": "<prompt> "},
    {},
    {},
]


def transcripts(conversations: DataFrame) -> DataFrame:
    """Conversations as people paste them: one marker style each, chosen by conversation, roles kept for learning."""
    style = F.pmod(F.xxhash64("conv_id"), F.lit(len(STYLES)))
    marker = F.lit("")
    for i, names in enumerate(STYLES):
        for role, shown in names.items():
            marker = F.when((style == i) & (F.col("role") == role), shown).otherwise(marker)
    bare = F.array(*[F.lit(not names) for names in STYLES])[style.cast("int")]
    text = F.concat(marker, F.coalesce("text", F.lit("")), F.when(bare, F.lit("\n")).otherwise(F.lit("")))
    return conversations.select("conv_id", "turn", text.alias("text"), "role")


def op3_chat(spark: SparkSession, folder: str) -> DataFrame:
    held = chat.placed(transcripts(table(spark, folder, "conversations")), "conv_id", "turn", "text", "role")
    model = chat.learn(held.filter(fold("conv", 5) != 0))
    out = chat.turns(held.drop("role"), model).withColumn("held_out", fold("conv", 5) == 0)
    return out.withColumnsRenamed({"conv": "conv_id", "place": "turn"})


def op4_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return jaccard.similarity_classes(docs).select("doc_id", "class_id", "n_links", "kept")


def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", (fold("doc_id", 5) == 0).alias("held_out"))
    model = toxicity.learn(docs.filter(~F.col("held_out")), table(spark, folder, "labels"))
    return toxicity.score(docs, model).select("doc_id", "held_out", "score", "predicted")


def op6_packing(spark: SparkSession, folder: str) -> DataFrame:
    packed = packing.pack(table(spark, folder, "documents"))
    return packed.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket"
    )


def op7_near_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return rotation_codes.near_vectors(table(spark, folder, "embeddings"))


def op8_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return cross_polytope.search(table(spark, folder, "embeddings"), F.col("id") % 100 == 0)


def op9_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.encode(table(spark, folder, "documents")).drop("ids")


def op10_language_model(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    held_out: Column = fold("doc_id", 7) == 2
    scored = loglinear.score(docs, docs.filter(~held_out))
    return scored.select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


def op11_ranked(spark: SparkSession, folder: str) -> DataFrame:
    # Rows with the same id are one item, as in the SQL: ranks are unique within an item.
    items = table(spark, folder, "benchmark").groupBy("item_id").agg(F.concat_ws(" ", F.collect_list("text")).alias("text"))
    return impact_lists.search(table(spark, folder, "documents"), items)


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations with the faults of careless exports, chosen by the checksum of conversation and turn; lost rows are not present."""
    text = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    held = conversations.select("conv_id", "turn", *text[2:]).toDF("conv_id", "turn", "role", "text")
    kind = F.crc32(F.concat(text[0], F.lit(":"), text[1]).cast("binary")) % 20
    held = held.withColumn("kind", kind)
    bare = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return held.select("conv_id", "turn", role.alias("role"), bare.alias("text"), (F.col("kind") != 0).alias("present"), copies).drop("col")


def op12_repair(spark: SparkSession, folder: str) -> DataFrame:
    rows = damaged(table(spark, folder, "conversations"))
    held = repair.placed(rows, "conv_id", "turn", "role", "text", F.col("present"))
    return repair.conversations(repair.pieces(held)).withColumnRenamed("conv", "conv_id")


def op13_main_text(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    return main_text.extract(pages, main_text.learn(pages)).select("page_id", "url", "text", "n_chars")


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_store, op2_language, op3_chat, op4_jaccard, op5_toxicity, op6_packing, op7_near_vectors, op8_neighbours,
        op9_pieces, op10_language_model, op11_ranked, op12_repair, op13_main_text,
    )
}

_COMPONENTS = """
{links},
reach(a, b) AS (
    SELECT x, x FROM nodes
    UNION
    SELECT r.a, l.y FROM reach r JOIN links l ON l.x = r.b
),
roots AS (SELECT a AS x, min(b) AS root FROM reach GROUP BY a),
degrees AS (SELECT x, count(*) AS n_links FROM links GROUP BY x)
"""

ORACLES = {
    "op4_jaccard": "WITH RECURSIVE"
    + _COMPONENTS.format(
        links=r"""
words AS (
    SELECT doc_id AS x, regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+') AS w FROM documents
),
nodes AS (SELECT x FROM words),
grams AS (
    SELECT DISTINCT x, array_to_string(w[i:i + 4], ' ') AS g
    FROM (SELECT x, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM words WHERE len(w) > 0)
),
sizes AS (SELECT x, count(*) AS n FROM grams GROUP BY x),
common AS (SELECT a.x, b.x AS y, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.x <> b.x GROUP BY a.x, b.x),
links AS (
    SELECT c.x, c.y FROM common c JOIN sizes p ON p.x = c.x JOIN sizes q ON q.x = c.y WHERE 5 * c.c >= 4 * (p.n + q.n - c.c)
)"""
    )
    + """
SELECT x AS doc_id, root AS class_id, coalesce(n_links, 0)::BIGINT AS n_links, root = x AS kept
FROM roots LEFT JOIN degrees USING (x)""",
    "op7_near_vectors": "WITH RECURSIVE"
    + _COMPONENTS.format(
        links="""
good AS (
    SELECT vec_id AS x, embedding::DOUBLE[] AS v FROM embeddings
    WHERE len(embedding) > 0 AND NOT list_contains(list_transform(embedding, lambda z: z IS NULL OR NOT isfinite(z)), true)
        AND list_contains(list_transform(embedding, lambda z: z <> 0), true)
),
nodes AS (SELECT vec_id AS x FROM embeddings),
links AS (
    SELECT a.x, b.x AS y FROM good a JOIN good b ON a.x <> b.x AND len(a.v) = len(b.v)
    WHERE list_cosine_similarity(a.v, b.v) >= 0.9
)"""
    )
    + """
SELECT x AS vec_id, coalesce(n_links, 0)::BIGINT AS n_links, root AS component_id, root = x AS kept
FROM roots LEFT JOIN degrees USING (x)""",
    "op11_ranked": r"""
WITH words AS (
    SELECT doc_id, regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+') AS w FROM documents
),
lengths AS (SELECT doc_id, len(w)::BIGINT AS n FROM words WHERE len(w) > 0),
totals AS (SELECT count(*)::BIGINT AS documents, sum(n)::BIGINT AS terms FROM lengths),
counts AS (SELECT doc_id, t, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS t FROM words) GROUP BY doc_id, t),
rarity AS (
    SELECT t, floor(1000 * ln((2 * any_value(documents) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM counts, totals GROUP BY t
),
asked AS (
    SELECT item_id, t, count(*) AS r
    FROM (
        SELECT item_id, unnest(regexp_extract_all(
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+')) AS t FROM benchmark
    ) GROUP BY item_id, t
),
scores AS (
    SELECT item_id, doc_id,
        sum(r * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * documents) // terms))))::BIGINT AS score
    FROM asked JOIN rarity USING (t) JOIN counts USING (t) JOIN lengths USING (doc_id), totals
    GROUP BY item_id, doc_id
)
SELECT item_id, rank, doc_id, score
FROM (
    SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM scores WHERE score > 0
) WHERE rank <= 10""",
}
