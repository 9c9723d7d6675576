"""The canonical record: one conversation session per row.

Free-form JSON (tool input, raw output, extensions) is kept as JSON text; an
empty string and null both mean absent.
"""

BLOCK = "struct<type:string,text:string,media_type:string,data:string,url:string,name:string>"
OUTPUT = f"struct<text:string,content:array<{BLOCK}>,raw:string>"
CALL = f"struct<tool:string,input:string,output:{OUTPUT},status:string>"
TURN = f"struct<role:string,timestamp:string,text:string,reasoning:string,tool_calls:array<{CALL}>,attachments:array<{BLOCK}>,extensions:string>"
USAGE = "struct<user_turns:bigint,assistant_turns:bigint,tool_calls:bigint,input_tokens:bigint,output_tokens:bigint>"
PROVENANCE = "struct<source_path:string,source_id:string,source_origin:string,extracted_at:string,version:string,extensions:string>"
RECORD = (
    "record_id string, origin string, grouping string, model string, branch string, started_at string, ended_at string, "
    f"working_dir string, title string, turns array<{TURN}>, usage {USAGE}, extensions string, _provenance {PROVENANCE}"
)
