"""The corpus pipeline: quality, near duplicates, repeated strings, mix of sources, packed sequences.

Every stage takes (spark, docs, sf_dir), works on all rows that the stage before kept, and returns a
DataFrame. ``run`` writes each result to the shared folder and reads it back as the next one's docs.
"""

from halocline.llm import bayes_join, mixing, prefix_free, quality_rules, vector_packing
from halocline.llm.common import stored, table
from halocline.llm.queries import word_tokenizer


def quality(spark, docs, sf_dir):
    """Keep the documents that the rule ensemble, fitted on ``labels``, does not reject."""
    return quality_rules.accepted(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark, docs, sf_dir):
    """Keep one document of each class of near duplicates."""
    return bayes_join.one_of_each_class(docs)


#: Bytes that a passage of 50 words has at least: words of some four letters, and the blanks between them.
PASSAGE, PASSAGE_ANCHOR = 240, 48


def repeated_strings(spark, docs, sf_dir):
    """Take passages of 50 words, at least PASSAGE bytes, that occur twice out of the texts; rows stay."""
    return prefix_free.cleaned(docs, PASSAGE, PASSAGE_ANCHOR)


def source_mix(spark, docs, sf_dir):
    """Take every document as often as the mix of sources wants it."""
    return mixing.mixed(docs)


#: Words whose ids a worker remembers, up to twice as many; it holds them beside what the other stages keep.
REMEMBERED = 100_000


def packing(spark, docs, sf_dir):
    """Pieces of tokens and their places in sequences."""
    return vector_packing.pack_documents(docs, word_tokenizer(), remembered=REMEMBERED)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_strings", repeated_strings),
    ("source_mix", source_mix),
    ("packing", packing),
]

#: Classifier, shingle join, knapsack and tokenizer have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The packed pieces of all documents that pass the stages."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
