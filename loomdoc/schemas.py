"""Schemas and vocabularies of the data model. Fixed values."""

from __future__ import annotations

ELEMENT_TYPES = ("heading", "paragraph", "list", "table", "figure", "figure_caption", "diagram", "icon", "warning", "note", "error_code")
CHUNK_TYPES = ("text", "table", "figure", "procedure", "entity")
PAGE_FLAGS = ("text_normal", "low_text_confidence", "vector_diagram", "raster_image")
TASK_TYPES = ("table_reparse", "visual_description", "full_page_ocr")

DOCUMENT = "id int, title string, manufacturer string, model_family string, filename string, source_hash string, source_pdf_uri string, version int, page_count int, status string, uploaded_at timestamp, org_id int"
PAGE = "id int, document_id int, page_number int, page_image_uri string, text_layer_present boolean, extraction_method string, page_hash string"
BBOX = "struct<l:double,t:double,r:double,b:double,page_number:int,coord_origin:string>"
VISUAL = "struct<figure_type:string,components:array<string>,connections:array<string>,description:string>"
ENTITY = "struct<name:string,entity_type:string,confidence:double,element_id:bigint,page:bigint,extraction_method:string,justification_span:array<int>,context_anchor_matched:boolean,cross_source_corroborated:boolean,corroboration_count:bigint>"
RELATION = "struct<subject:string,predicate:string,object:string,confidence:double,element_id:bigint,page:bigint,extraction_method:string>"
ELEMENT = f"id bigint, document_id bigint, page_id bigint, element_type string, text string, bbox {BBOX}, parent_id bigint, section_path array<string>, image_uri string, source_hash string, extraction_method string, extraction_confidence double, visual_description {VISUAL}, kg_candidate_entities array<{ENTITY}>, kg_candidate_relations array<{RELATION}>"
STEPS = "array<struct<step_number:int,step_text:string,element_id:bigint>>"
CHUNK = f"document_id bigint, chunk_no int, chunk_type string, section_path array<string>, page_start bigint, page_end bigint, content_text string, element_ids array<bigint>, n_steps int, steps {STEPS}, own_text string, image_uri string, description string"
JOB = "id bigint, document_id bigint, celery_task_id string, stage string, status string, started_at timestamp, finished_at timestamp, error_message string, stage_metrics struct<duration_ms:bigint>"
