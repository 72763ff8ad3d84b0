"""Schemas of the engine's tables."""

DOCUMENTS = "doc_seq INT, path STRING, source_doc STRING"
RAW_PAGES = "source_doc STRING, page_num INT, raw_text STRING, raw_tables ARRAY<ARRAY<ARRAY<STRING>>>"
BLOCKS = "source_doc STRING, page_num INT, block_no INT, x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE, text STRING"
TABLE_BOXES = "source_doc STRING, page_num INT, x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE"
PAGES = "source_doc STRING, page_num INT, text STRING, tables ARRAY<STRING>"
CHUNKS = "chunk_seq LONG, chunk_id STRING, source_doc STRING, page_start INT, page_end INT, text STRING, is_table BOOLEAN, token_count INT"
RAW_RECORDS = (
    "record_seq LONG, system STRING, question STRING, answer STRING, source_doc STRING, page_start INT, page_end INT, "
    "chunk_id STRING, chunk_token_count INT, is_table BOOLEAN"
)
