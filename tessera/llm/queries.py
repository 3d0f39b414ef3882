"""Queries of the text operators, and SQL for those that SQL can express."""

from __future__ import annotations

from .collocations import OP13_SQL, op13_phrase_collocations
from .decontaminate import OP3_SQL, op3_decontamination
from .extract import op4_html_extraction
from .language import op2_language_id
from .licenses import op1_license_scan
from .packing import op12_best_fit_packing
from .pieces import op6_sentencepiece
from .quality import OP5_SQL, op5_quality_rules
from .resample import OP11_SQL, op11_importance_resampling
from .simhash import op10_simhash_near_dedup
from .suffix_dedup import OP9_SQL, op9_suffix_dedup
from .urls import OP8_SQL, op8_url_filter
from .warc import op7_warc

QUERIES = {f.__name__: f for f in (op1_license_scan, op2_language_id, op3_decontamination, op4_html_extraction, op5_quality_rules, op6_sentencepiece, op7_warc, op8_url_filter, op9_suffix_dedup, op10_simhash_near_dedup, op11_importance_resampling, op12_best_fit_packing, op13_phrase_collocations)}
ORACLE = {"op3_decontamination": OP3_SQL, "op5_quality_rules": OP5_SQL, "op8_url_filter": OP8_SQL, "op9_suffix_dedup": OP9_SQL, "op11_importance_resampling": OP11_SQL, "op13_phrase_collocations": OP13_SQL}
