"""The subpackage's registered queries and, where SQL can express one, its DuckDB text."""

from __future__ import annotations

from .bpe import op6_bpe
from .decontaminate import op9_decontamination
from .imatch import op1_imatch
from .jaccard_join import OP5_SQL, op5_jaccard_join
from .langid import op10_language_id
from .licenses import OP3_SQL, op3_license_scan
from .merkle import op13_merkle
from .pii import op8_pii
from .secret_scan import OP12_SQL, op12_secret_scan
from .spelling import op11_spelling
from .suffix_dedup import op4_suffix_dedup
from .toxicity import op2_toxicity
from .url_filter import OP7_SQL, op7_url_filter

QUERIES = {
    "op1_imatch": op1_imatch,
    "op2_toxicity": op2_toxicity,
    "op3_license_scan": op3_license_scan,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_bpe": op6_bpe,
    "op7_url_filter": op7_url_filter,
    "op8_pii": op8_pii,
    "op9_decontamination": op9_decontamination,
    "op10_language_id": op10_language_id,
    "op11_spelling": op11_spelling,
    "op12_secret_scan": op12_secret_scan,
    "op13_merkle": op13_merkle,
}
ORACLES = {"op3_license_scan": OP3_SQL, "op5_jaccard_join": OP5_SQL, "op7_url_filter": OP7_SQL, "op12_secret_scan": OP12_SQL}
