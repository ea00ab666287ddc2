"""The corpus pipeline; each stage takes (spark, docs, sf_dir) and returns a DataFrame.

Quality rules reject documents, exact dedup keeps one row of each text, the n-gram
Jaccard join keeps one document of each group of near duplicates, mixing keeps rows at
the rates that meet the target weights of the domains, and the last stage encodes what
is left. Each stage works on all that the one before it kept; its result is written to
the shared folder and read again, so a lost executor costs a task, not a lineage.

Defined results: a null, empty or blank text has no words, so the first stage rejects it;
no other stage sees one. A null doc_id is a document like others: of copies and near
copies the row of least doc_id stays, nulls last. Repeated rows are copies. Texts are
read whole, however long. Without labels every posterior is uniform, so mixing drops by
chance alone, at rates that meet the targets as nearly as can be. An empty table gives an
empty table. Columns beyond doc_id and text may have any name and hold nulls; all come
out as they went in, but for those named token_ids, starts or ends, in any case, which
the last stage replaces.
"""

from stratum.llm import bpe, exact_dedup, mixing, ngram_join, quality_rules
from stratum.llm._io import materialise


def quality(spark, docs, sf_dir):
    return quality_rules.accepted(docs)


def copies(spark, docs, sf_dir):
    return exact_dedup.without_copies(docs)


def near_copies(spark, docs, sf_dir):
    return ngram_join.one_of_each(docs)


def mixture(spark, docs, sf_dir):
    return mixing.sample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def tokens(spark, docs, sf_dir):
    return bpe.encode(docs)


STAGES = [
    ("quality rules", quality),
    ("exact dedup", copies),
    ("n-gram Jaccard join", near_copies),
    ("mixing sources to target weights", mixture),
    ("byte-level BPE encoding and decoding", tokens),
]
#: A fitted classifier and a tokenizer are no SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    """doc_id, the other columns of documents, token_ids, starts and ends of the documents that all stages keep."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
