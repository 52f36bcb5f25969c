"""The corpus operators' queries and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from waymark.llm.decontamination import OP8_SQL, op8_decontamination
from waymark.llm.language import op1_language_id
from waymark.llm.lines import OP3_SQL, op3_line_dedup
from waymark.llm.near_duplicates import OP7_SQL, op7_near_duplicates
from waymark.llm.neighbours import op4_nearest_neighbours
from waymark.llm.packing import op5_packing
from waymark.llm.passages import OP10_SQL, op10_repeated_passages
from waymark.llm.periods import op11_periodic_runs
from waymark.llm.quality import op2_quality
from waymark.llm.secrets import op12_secret_scan
from waymark.llm.toxicity import op9_toxicity
from waymark.llm.warc import OP6_SQL, op6_warc
from waymark.llm.whitening import op13_embedding_whitening

QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_quality": op2_quality,
    "op3_line_dedup": op3_line_dedup,
    "op4_nearest_neighbours": op4_nearest_neighbours,
    "op5_packing": op5_packing,
    "op6_warc": op6_warc,
    "op7_near_duplicates": op7_near_duplicates,
    "op8_decontamination": op8_decontamination,
    "op9_toxicity": op9_toxicity,
    "op10_repeated_passages": op10_repeated_passages,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_secret_scan": op12_secret_scan,
    "op13_embedding_whitening": op13_embedding_whitening,
}
ORACLE_SQL: dict[str, str] = {
    "op3_line_dedup": OP3_SQL,
    "op6_warc": OP6_SQL,
    "op7_near_duplicates": OP7_SQL,
    "op8_decontamination": OP8_SQL,
    "op10_repeated_passages": OP10_SQL,
}
