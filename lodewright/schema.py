"""Schemas of the tables that the operators exchange."""

from __future__ import annotations

# Layout categories, by their number in annotations.
CATEGORIES = {1: "text", 2: "title", 3: "list", 4: "table", 5: "figure"}
TEXTUAL = "text", "title", "list"
VISUAL = "table", "figure"
ENTITY_TYPES = "method", "metric", "dataset", "finding", "figure_ref"
QUERY_TYPES = "text_answerable", "visual_requiring", "multi_hop"

BBOX = "struct<x:double,y:double,w:double,h:double>"
REGIONS = f"region_id string, doc_id string, page_id string, region_type string, bbox {BBOX}, text string, image_path string, ocr_confidence double"
CHUNKS = "chunk_id string, doc_id string, page_id string, text string, source_region_ids array<string>"
RANKING = "query_id string, item_id string, score double, modality string, rank int"
QUESTIONS = "qa_id string, question string, query_type string, gold_region_ids array<string>, gold_answer string, doc_id string"
NODES = "id string, name string, entity_type string, source_region_ids array<string>"
EDGES = "head string, tail string, relation_type string, source_region_id string"
RETRIEVAL_LOG = "qa_id string, question string, query_type string, gold_region_ids array<string>, retrieved_region_ids array<string>"
