"""From raw documents to token ids, in five stages that each take and return a table of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutroom.llm import bpe, decontaminate, langid, minhash, pii
from cutroom.llm.queries import tokenizer_file
from cutroom.session import settle, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: lang becomes the predicted one; texts in no language (null, empty, without letters) go.

    Repeated rows and ids are predicted each; all columns stay, those named as the operator's own too. Languages
    that score alike: the first in order. An empty table, or one without labels, has no languages: every row goes.
    """
    row = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["text"].alias("text"))
    found = langid.identify(row, langid.fit(docs)).where("lang_pred <> 'und'")
    return found.select(F.col("row").withField("lang", F.col("lang_pred")).alias("row")).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10 on five words at 0.8: the document of least id stays of each group, those without an id after all others.

    Rows that repeat id and text are one document and one of them stays; rows that repeat an id with another
    text are judged for themselves. Null, empty and wordless texts are near nothing and stay. All columns stay.
    """
    return minhash.one_of_each_group(docs, k=5, percent=80)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents that hold a benchmark item go, with all rows of their id.

    Null and empty texts hold none, and rows without an id stay, as nothing can name them. All columns stay.
    """
    return decontaminate.without_benchmark(docs, table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: spans of personal data become placeholders; n_chars is counted anew (null for a null text).

    Every row stays, repeated ones and those without an id too, and so do all other columns.
    """
    return pii.redact_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: doc_id and the token ids of every text, with digests of the ids and of the bytes they decode to.

    A row for each row, repeated ones and null ids too; a null or empty text has no tokens. Other columns go.
    """
    return bpe.encode_documents(docs, *tokenizer_file(), outputs=("n_tokens", "ids", "ids_sha256", "decoded_sha256"))


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", drop_benchmark),
    ("pii", redact_personal_data),
    ("encode", encode),
]

#: Language models, edit distances and byte-level merges have no SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each reads what the one before has written, so nothing is worked out twice and a lost executor costs one stage at most."""
    docs = table(spark, sf_dir, "documents")
    for place, (_, stage) in enumerate(STAGES, 1):
        made = stage(spark, docs, sf_dir)
        docs = settle(made) if place < len(STAGES) else made
    return docs
