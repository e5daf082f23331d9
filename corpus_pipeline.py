"""The corpus pipeline: five stages over the documents, each a table for the next.

Language ID drops texts without a language, the n-gram Jaccard join leaves one
document of each group of near copies, the suffix-array dedup takes repeated
passages out, the mix brings the sources to equal weights, and the packing assigns
what is left to length buckets and batches.

Nulls, empties and ties: a null, empty or letterless text is rejected by the first
stage.  Where there is no labelled row, nothing else is.  A row without ``doc_id``
has no near copies and no passages in common, so it passes the second and third stage
as it is, is mixed as the empty id and packed under a null id.  Rows that repeat id
and text stay, all of them, up to the mix, which draws each by its own odds.  A null
source is a source of its own, a null ``n_chars`` a length of 1; ties go to the
lowest id.  An empty table gives an empty result, and extra columns pass all stages
but the last, whatever their names.
"""

from __future__ import annotations

from orrery.llm import langid, mixing, ngram_join, packing, suffix_dedup
from orrery.llm.common import cut, release, table, written


def language_id(spark, docs, sf_dir):
    return langid.keep_identified(docs)


def ngram_jaccard(spark, docs, sf_dir):
    return ngram_join.drop_near_copies(docs)


def suffix_array(spark, docs, sf_dir):
    return suffix_dedup.drop_repeats(docs)


def source_mix(spark, docs, sf_dir):
    return mixing.mixed(docs)


def length_buckets(spark, docs, sf_dir):
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard", ngram_jaccard),
    ("suffix_array", suffix_array),
    ("source_mix", source_mix),
    ("length_buckets", length_buckets),
]

#: The classifiers of the first stage cannot be written as SQL; tests run the
#: stages against brute force instead.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The stages one after the other; what a stage wrote on its way goes when its result is there."""
    docs, kept = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        begun = written()
        done = cut(spark, stage(spark, docs, sf_dir), name)
        release(spark, begun, written() - 1)
        if kept is not None:
            release(spark, kept, kept + 1)
        docs, kept = done, written() - 1
    return STAGES[-1][1](spark, docs, sf_dir)
