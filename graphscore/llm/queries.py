"""The queries of this subpackage, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from . import decontaminate, neardup, substring
from .decontaminate import op1
from .language import op7
from .licenses import op2
from .markup import op3
from .mixing import op4
from .neardup import op9
from .packing import op8
from .pii import op5
from .quality import op10
from .substring import op6

QUERIES = {"op1_decontamination": op1, "op2_license_scan": op2, "op3_html_extraction": op3, "op4_source_mixing": op4, "op5_pii_spans": op5, "op6_substring_dedup": op6, "op7_language_id": op7, "op8_token_packing": op8, "op9_minhash_neardup": op9, "op10_quality_rules": op10}
ORACLES: dict[str, str] = {"op1_decontamination": decontaminate.SQL, "op6_substring_dedup": substring.SQL, "op9_minhash_neardup": neardup.SQL}
