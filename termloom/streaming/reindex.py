"""Continuous re-indexing: each batch of new pages is brought into the knowledge base."""

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from termloom.api import index_pages
from termloom.operators.kb import KnowledgeBase


def reindex_stream(pages: DataFrame, kb_path: str, domain: str, checkpoint: str, invalidated: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """pages is a stream of (url, html). Each batch is indexed against the newest base under kb_path and written as its next
    version; invalidated(urls, batch) gets what is to be linked again. Of one url in a batch the revision that index_pages() keeps counts.

    A version carries its batch's number, so a batch that is run again after a failure is written once: if its version is
    whole, nothing happens; if it broke off, it is made again from the version before it. Invalidated urls are handed over
    before the version is completed, that is, at least once."""

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if KnowledgeBase.has(spark, kb_path, number + 1):
            return
        kb, urls = index_pages(batch, KnowledgeBase.read(spark, kb_path), domain)
        invalidated(urls, number)
        kb.write(kb_path, number + 1)

    return pages.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
