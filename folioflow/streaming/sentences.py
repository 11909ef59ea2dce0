"""The sentence stream as a Structured Streaming operator: one state per document, pages taken in order.

Pages may arrive in any order and any micro-batch split; they wait in the state until all before them are there. A row
with `last` true says that a document has no further page. State holds the running texts and the waiting pages; once the last
page is through, only a mark stays for TOMBSTONE, so that redelivered pages give nothing, and then goes too.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from folioflow.operators.sentence_stream import SENTENCE_SCHEMA, SentenceStream, sentence_frame

TOMBSTONE = 24 * 3600 * 1000
PAGE_SCHEMA = (
    "documentId string, pageNumber int, last boolean, blocks array<struct<readingOrder:int,type:string,layoutLabel:string,selectableBody:boolean,left:double,top:double,right:double,bottom:double,"
    "lines:array<struct<text:string,left:double,top:double,right:double,bottom:double,confidence:double,isFormula:boolean>>>>"
)


def _blocks(value) -> list[dict]:
    return [dict(b, lines=[dict(x) for x in b["lines"]]) for b in (dict(v) for v in value)]


def stream_sentences(pages: DataFrame, keep: int = TOMBSTONE) -> DataFrame:
    """pages as in PAGE_SCHEMA, numbered from 0 without gaps -> sentences as they are committed. `keep` is how long, in
    milliseconds, a finished document is remembered."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        stream, wanted, waiting, end = pickle.loads(state.get[0]) if state.exists else (SentenceStream(), 0, {}, None)
        found: list[dict] = []
        for p in batches:
            for r in p.itertuples():
                if stream is not None and r.pageNumber >= wanted:  # a page that was seen is a redelivery
                    waiting[r.pageNumber] = _blocks(r.blocks)
                    end = r.pageNumber if r.last else end
        while stream is not None and wanted in waiting:
            found += stream.add_page(wanted, waiting.pop(wanted))
            wanted += 1
            if end is not None and wanted > end:
                found += stream.finish()
                stream, waiting = None, {}
        state.update((pickle.dumps((stream, wanted, waiting, end)),))
        if stream is None:
            state.setTimeoutDuration(keep)
        yield sentence_frame([(key[0], s) for s in found])

    return pages.groupBy("documentId").applyInPandasWithState(step, SENTENCE_SCHEMA, "state binary", "append", GroupStateTimeout.ProcessingTimeTimeout)
