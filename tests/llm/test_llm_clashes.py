"""Results never have two columns of one name."""

import public_tokenizers
import pytest

from cairnfield.llm import caps, decontaminate, langid, secrets, setjoin, token_counts
from cairnfield.llm.queries import BYTE_BPE, PIECES


def test_clashing_names_are_refused(spark):
    docs = spark.createDataFrame([(1, "a b", "en", 0.5)], "doc_id long, text string, lang string, score double")
    named = lambda n: docs.withColumnRenamed("doc_id", n)
    pieces, bpe = public_tokenizers.path(PIECES), public_tokenizers.path(BYTE_BPE)
    vectors = spark.createDataFrame([(1, [1.0])], "kept long, embedding array<float>")
    calls = [
        lambda: langid.predict(docs, pieces, [], langid.np.zeros((0, 0)), keep=["score"]),
        lambda: langid.predict(docs, pieces, [], langid.np.zeros((0, 0)), keep=["doc_id"]),
        lambda: decontaminate.find_leaks(docs, docs, item_key="doc_id"),
        lambda: decontaminate.find_leaks(named("n_item"), docs, doc_key="n_item", item_key="doc_id"),
        lambda: secrets.find_secrets(named("secrets"), key="secrets"),
        lambda: token_counts.count_tokens(named("n_tokens"), bpe, key="n_tokens"),
        lambda: setjoin.jaccard_components(named("n_shingles"), key="n_shingles"),
        lambda: caps.near_vectors(vectors, key="kept"),
    ]
    for call in calls:
        with pytest.raises(ValueError):
            call()
