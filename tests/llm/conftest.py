import os

import pytest

SF = "/root/testdata/sf0.001"
TOKENIZERS = "/opt/tokenizers"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
needs_tokenizers = pytest.mark.skipif(not os.path.isdir(TOKENIZERS), reason="needs the public tokenizers")

KINDS = {
    "sentences": "id string, documentId string, pageNumber int, position int, originalText string, correctedText string, regions string, source string, confidence float, text string, salt int, k string",
    "ai_correction_reviews": "sentenceId string, documentId string, pageNumber int, pdfOriginalText string, parsedText string, proposedText string, translatedText string, createdAt bigint, ingestedAt timestamp_ntz, id string, n int",
    "library_documents": "id string, title string, folderId string, doc string, src string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint, documentId string, title string, k string, size int, ids string",
    "size_limits": "limit_id int, purpose string, tokenizer string, max_tokens int, overlap_tokens int",
}


@pytest.fixture
def tables(spark, tmp_path):
    """Writes small tables, with extra columns whose names clash with the operators' own; rows are dicts."""

    def put(**given):
        for name, ddl in KINDS.items():
            cols = [c.split()[0] for c in ddl.split(", ")]
            rows = [tuple(r.get(c) for c in cols) for r in given.get(name, [])]
            spark.createDataFrame(rows, ddl).coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return put
