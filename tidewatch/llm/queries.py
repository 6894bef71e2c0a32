"""Queries of the training-data operators and their SQL."""

from tidewatch.llm.bpe import op11_bpe
from tidewatch.llm.centroids import OP13_SQL, op13_centroids
from tidewatch.llm.decontamination import op6_decontamination
from tidewatch.llm.fingerprints import op2_fingerprints
from tidewatch.llm.html import op5_html
from tidewatch.llm.licenses import op7_licenses
from tidewatch.llm.negatives import OP12_SQL, op12_negatives
from tidewatch.llm.packing import op8_packing
from tidewatch.llm.pii import op1_pii
from tidewatch.llm.simhash import op4_simhash
from tidewatch.llm.toxicity import op10_toxicity
from tidewatch.llm.urls import OP9_SQL, op9_urls
from tidewatch.llm.warc import OP3_SQL, op3_warc

QUERIES = {
    f.__name__: f
    for f in (op1_pii, op2_fingerprints, op3_warc, op4_simhash, op5_html, op6_decontamination, op7_licenses, op8_packing,
              op9_urls, op10_toxicity, op11_bpe, op12_negatives, op13_centroids)
}
ORACLES = {"op3_warc": OP3_SQL, "op9_urls": OP9_SQL, "op12_negatives": OP12_SQL, "op13_centroids": OP13_SQL}
