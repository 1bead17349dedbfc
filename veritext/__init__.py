"""veritext: corpus search and answer assembly as Spark DataFrame jobs.

Layout
------
functions/  Column-expression builders (text cleaning, tokens, vectors, formats)
sources/    readers and writers (driver tables, HTML folders, JSON chunks, sinks)
operators/  DataFrame -> DataFrame operators (corpus, embed, retrieve, rerank,
            answer, phrases, question log)
plans/      end-to-end jobs (index build, question answering) and the query
            catalogue used by ``__spark_entry__``
streaming/  Structured Streaming form of the question loop
"""

__version__ = "0.1.0"
