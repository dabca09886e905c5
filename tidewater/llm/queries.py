"""The registered queries of this subpackage and their SQL."""

from tidewater.llm import exact_dedup, fill_in_middle, hard_negatives, substring_dedup, url_filter, warc
from tidewater.llm.decontaminate import op8_decontamination
from tidewater.llm.license_scan import op7_license_scan
from tidewater.llm.lm_score import op9_lm_score
from tidewater.llm.quality import op2_quality
from tidewater.llm.sentencepiece_codec import op4_sentencepiece
from tidewater.llm.simhash_dedup import op5_simhash_dedup
from tidewater.llm.toxicity import op1_toxicity

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_quality": op2_quality,
    "op3_url_filter": url_filter.op3_url_filter,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_simhash_dedup": op5_simhash_dedup,
    "op6_exact_dedup": exact_dedup.op6_exact_dedup,
    "op7_license_scan": op7_license_scan,
    "op8_decontamination": op8_decontamination,
    "op9_lm_score": op9_lm_score,
    "op10_substring_dedup": substring_dedup.op10_substring_dedup,
    "op11_warc": warc.op11_warc,
    "op12_fill_in_middle": fill_in_middle.op12_fill_in_middle,
    "op13_hard_negatives": hard_negatives.op13_hard_negatives,
}

SQL = {
    "op3_url_filter": url_filter.OP3_SQL, "op6_exact_dedup": exact_dedup.OP6_SQL, "op10_substring_dedup": substring_dedup.OP10_SQL, "op11_warc": warc.OP11_SQL,
    "op12_fill_in_middle": fill_in_middle.OP12_SQL, "op13_hard_negatives": hard_negatives.OP13_SQL,
}
