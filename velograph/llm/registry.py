"""The queries of the corpus operators, and their SQL."""

from velograph.llm import op03_decontaminate, op06_urls, op07_chat, op08_licenses, op11_codes, op12_centroids, op13_setsketch
from velograph.llm.op01_sentencepiece import op1_sentencepiece
from velograph.llm.op02_language import op2_language_id
from velograph.llm.op03_decontaminate import op3_decontaminate
from velograph.llm.op04_simhash import op4_simhash_dedup
from velograph.llm.op05_classifier import op5_quality_classifier
from velograph.llm.op06_urls import op6_url_filters
from velograph.llm.op07_chat import op7_chat_formatting
from velograph.llm.op08_licenses import op8_license_scans
from velograph.llm.op09_html import op9_html_extraction
from velograph.llm.op10_quality import op10_quality_rules
from velograph.llm.op11_codes import op11_vector_codes
from velograph.llm.op12_centroids import op12_centroid_clusters
from velograph.llm.op13_setsketch import op13_setsketch_dedup

QUERIES = {
    f.__name__: f
    for f in (
        op1_sentencepiece,
        op2_language_id,
        op3_decontaminate,
        op4_simhash_dedup,
        op5_quality_classifier,
        op6_url_filters,
        op7_chat_formatting,
        op8_license_scans,
        op9_html_extraction,
        op10_quality_rules,
        op11_vector_codes,
        op12_centroid_clusters,
        op13_setsketch_dedup,
    )
}
ORACLES: dict[str, str] = {
    "op3_decontaminate": op03_decontaminate.ORACLE_SQL,
    "op6_url_filters": op06_urls.ORACLE_SQL,
    "op7_chat_formatting": op07_chat.ORACLE_SQL,
    "op8_license_scans": op08_licenses.ORACLE_SQL,
    "op11_vector_codes": op11_codes.ORACLE_SQL,
    "op12_centroid_clusters": op12_centroids.ORACLE_SQL,
    "op13_setsketch_dedup": op13_setsketch.ORACLE_SQL,
}
