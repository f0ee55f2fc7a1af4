"""Explicit schemas of the nested data; nothing is inferred."""

from __future__ import annotations

CANDIDATE = "struct<title:string,description:string,type:string>"
CANDIDATES = f"array<{CANDIDATE}>"

STEP = "struct<step_num:int,action:string,expected_result:string,test_data:string>"

REQUIREMENT = "struct<title:string,description:string,type:string,requirement_id:string>"

METADATA = (
    "struct<source_file:string,extraction_timestamp:timestamp,"
    "extraction_model:string,validation_confirmed:boolean>"
)

ENRICHED = (
    "struct<is_requirement:boolean,short_title:string,description:string,"
    "user_story:string,acceptance_criteria:array<string>,"
    f"test_steps:array<{STEP}>,test_scenarios:array<string>,"
    "assumptions:array<string>,ambiguities:array<string>,confidence:string,"
    "extraction_model:string,extraction_timestamp:timestamp,"
    f"validation_confirmed:boolean,metadata:{METADATA}>"
)

ENRICHED_FIELDS = [
    "is_requirement",
    "short_title",
    "description",
    "user_story",
    "acceptance_criteria",
    "test_steps",
    "test_scenarios",
    "assumptions",
    "ambiguities",
    "confidence",
    "extraction_model",
    "extraction_timestamp",
    "validation_confirmed",
    "metadata",
]

MATCHED = (
    "struct<extracted_id:string,extracted_title:string,gt_id:string,"
    "gt_name:string,similarity:double,match_method:string>"
)
MISSED = "struct<gt_id:string,gt_name:string,description:string>"
OVER_CREATED = "struct<extracted_id:string,title:string,type:string,description:string>"

METRICS = "struct<precision:double,recall:double,f1_score:double>"
COUNTS = (
    "struct<gt:bigint,extracted:bigint,true_positives:bigint,"
    "false_negatives:bigint,false_positives:bigint>"
)


def document_of(item: str) -> str:
    """Schema of saved records: nested documents, or flat rows with a position."""
    fields = item[len("struct<"):-1]
    return f"struct<project:string,position:bigint,part:bigint,parts:bigint,requirements:array<{item}>,{fields}>"


REPORT_ROW = (
    f"project string, section string, position bigint, metrics {METRICS}, counts {COUNTS}, "
    f"matched {MATCHED}, missed {MISSED}, over_created {OVER_CREATED}, project_name string"
)


REPORT = (
    f"project string, part bigint, parts bigint, metrics {METRICS}, counts {COUNTS}, "
    f"matched array<{MATCHED}>, missed array<{MISSED}>, over_created array<{OVER_CREATED}>"
)
