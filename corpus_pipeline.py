"""The corpus pipeline: documents through five stages, each written and read again.

Each stage is a function of (spark, docs, sf_dir) that calls one operator of
``episodeflow.llm``. It gets what the stage before it kept; rows that a stage
rejects are gone for all later ones, and cleaned texts replace the old ones.
"""

from __future__ import annotations

from episodeflow.llm import bpe, decontaminate, secrets, simhash, toxicity
from episodeflow.llm.common import materialise, read_table

STAGES = [
    ("toxicity", toxicity.drop_toxic),
    ("near_duplicates", simhash.keep_one_of_each_group),
    ("decontamination", decontaminate.drop_contaminated),
    ("secrets", secrets.redact_secrets),
    ("tokens", bpe.encode_corpus),
]

#: Trained models, fingerprints and token ids are nothing that SQL can compute. Tests
#: hold the stages against brute-force versions over the documents of one table.
ORACLE_SQL = None


def run(spark, sf_dir: str):
    """Apply the stages to the documents; the last stage's rows."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
