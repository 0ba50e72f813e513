"""The registered queries of this subpackage. SQL holds those that DuckDB can express."""

from .compaction import op12_compaction
from .decontamination import op6_decontamination
from .html_extract import op4_html_extraction
from .language_id import op2_language_id
from .line_dedup import OP10_SQL, op10_line_dedup
from .packing import op7_best_fit_packing
from .simhash_dedup import op9_simhash_dedup
from .substring_dedup import OP1_SQL, op1_substring_dedup
from .suffix_dedup import OP5_SQL, op5_suffix_dedup
from .token_output import op3_token_output
from .topk_search import OP8_SQL, op8_exact_topk
from .url_filter import op13_url_filter
from .whitening import op11_whitening

_ALL = (
    op1_substring_dedup,
    op2_language_id,
    op3_token_output,
    op4_html_extraction,
    op5_suffix_dedup,
    op6_decontamination,
    op7_best_fit_packing,
    op8_exact_topk,
    op9_simhash_dedup,
    op10_line_dedup,
    op11_whitening,
    op12_compaction,
    op13_url_filter,
)
QUERIES = {f.__name__: f for f in _ALL}
SQL = {"op1_substring_dedup": OP1_SQL, "op5_suffix_dedup": OP5_SQL, "op8_exact_topk": OP8_SQL, "op10_line_dedup": OP10_SQL}
