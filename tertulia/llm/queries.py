"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import pii
from . import secrets as SEC
from . import toxicity as TOX
from .ann import nearest
from .common import spans_text, table
from .decontaminate import contaminated
from .hard_negatives import hard_negatives, relabelled
from .html_text import extract_text
from .line_dedup import dedup_lines
from .mixing import mix_sources
from .ngram_join import near_components
from .warc import round_trip, sha1_base32
from .sql import HARD_NEGATIVES_SQL, LINE_DEDUP_SQL, MIXING_SQL, URL_FILTER_SQL
from .token_align import alignment
from .url_filter import judge


def op1_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_removed", "text")


def op2_ngram_join(spark, sf_dir):
    return near_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_html(spark, sf_dir):
    text = extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return text.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op4_mixing(spark, sf_dir):
    return mix_sources(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def op8_warc(spark, sf_dir):
    r = round_trip(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    # What a response says of itself is computed anew from the payload read.
    raw = F.col("payload").cast("binary")
    return r.select(
        "page_id",
        F.when(F.col("payload").isNotNull(), F.octet_length("payload")).otherwise(F.col("http_length"))
        .cast("long").alias("payload_bytes"),
        F.when(F.col("payload").isNotNull(), sha1_base32(raw)).otherwise(F.col("payload_digest"))
        .alias("payload_digest"),
        "record_type", "refers_to")


def op9_decontamination(spark, sf_dir):
    return contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"),
                        table(spark, sf_dir, "benchmark").select("item_id", "text"))


def op10_pii(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find_pii(docs)
    counts = [pii.count_of(F.col("spans"), k).alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts,
                        F.sha2(pii.spans_text(F.col("spans"), len(pii.KINDS)), 256).alias("base_sha256"),
                        pii.spans_text(F.col("spans")).alias("spans"))


def op5_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = TOX.fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return TOX.score(docs, model).select(
        "doc_id", TOX.held_out(F.col("doc_id")).alias("held_out"), "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op6_ann(spark, sf_dir):
    return nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op7_secrets(spark, sf_dir):
    found = SEC.scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda x: x["kind"].isin(*SEC.BASE_KINDS))
    counts = [F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
              for kind in SEC.BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(spans_text(base), 256).alias("base_sha256"),
                        spans_text(F.col("spans")).alias("spans"))


def op11_token_alignment(spark, sf_dir):
    return alignment(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_hard_negatives(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    return hard_negatives(relabelled(vectors), F.col("vec_id") % 100 == 0)


def op13_url_filter(spark, sf_dir):
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"),
                 table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"))


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_ngram_join": op2_ngram_join,
    "op3_html": op3_html,
    "op4_mixing": op4_mixing,
    "op5_toxicity": op5_toxicity,
    "op6_ann": op6_ann,
    "op7_secrets": op7_secrets,
    "op8_warc": op8_warc,
    "op9_decontamination": op9_decontamination,
    "op10_pii": op10_pii,
    "op11_token_alignment": op11_token_alignment,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_url_filter": op13_url_filter,
}
ORACLE = {"op1_line_dedup": LINE_DEDUP_SQL, "op4_mixing": MIXING_SQL, "op12_hard_negatives": HARD_NEGATIVES_SQL,
          "op13_url_filter": URL_FILTER_SQL}
