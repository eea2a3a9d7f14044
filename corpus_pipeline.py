"""Documents to packed training sequences: quality filter, toxicity filter, SimHash near-duplicates, best-fit packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of documents. The
classifiers learn from the whole documents table's labelled rows, and decide on the rows they are given.

The SimHash stage finds near copies of five-word shingles at a similarity of 0.8, by op7's index of positional bytes (skarn.llm.simhash.similar says why its bytes are minimum hashes).

Defined results: a null or empty text is scored like any other by the classifiers, is a near copy of every other wordless one, and packs as the end id alone. Very long texts are
read whole and packed in pieces. Without labelled rows of both classes nothing is rejected. At exactly 0.7 quality (a tie) a document stays; of a group of near copies the smallest doc_id stays, of
rows that repeat a doc_id one; rows with a null doc_id all stay and pack. An empty table gives no rows. Columns beside doc_id and text, whatever their names, go through the filtering
stages untouched, and packing doesn't read them.
"""

import public_tokenizers

from skarn.llm import packing, quality, simhash, toxicity
from skarn.llm.common import prepare, table, written


def quality_stage(spark, docs, sf_dir):
    """Keeps documents with a score of at least 0.7."""
    model = quality.train(table(prepare(spark), sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality.accepted(docs, model)


def toxicity_stage(spark, docs, sf_dir):
    """Keeps documents whose chance of any toxic grade is under the operator's bound."""
    model = toxicity.train(table(prepare(spark), sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.harmless(docs, model)


def simhash_stage(spark, docs, sf_dir):
    """Keeps one document of each group of near copies: that with the smallest doc_id."""
    prepare(spark)
    return simhash.keep_one(docs, simhash.similar(docs))


def packing_stage(spark, docs, sf_dir):
    """A row per piece with its place in a sequence."""
    prepare(spark)
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", quality_stage), ("toxicity", toxicity_stage), ("simhash", simhash_stage), ("packing", packing_stage)]
#: The classifiers, XXH64 and the tokenizer are outside SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
