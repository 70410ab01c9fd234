"""The corpus queries by name, with production parameters, and DuckDB SQL where it can say them."""

from __future__ import annotations

from . import centroids, decontaminate, warc
from .centroids import op11_centroids
from .decontaminate import op6_decontamination
from .html import op4_html_extraction
from .licenses import op8_license_scan
from .lm import op9_lm_scoring
from .mixing import op5_mixing
from .pivots import op13_near_vectors
from .quality import op1_quality_classifier
from .rules import op3_quality_rules
from .runs import op12_periodic_runs
from .sharding import op7_sharding
from .simhash import op2_simhash_near_dedup
from .warc import op10_warc

QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_classifier,
        op2_simhash_near_dedup,
        op3_quality_rules,
        op4_html_extraction,
        op5_mixing,
        op6_decontamination,
        op7_sharding,
        op8_license_scan,
        op9_lm_scoring,
        op10_warc,
        op11_centroids,
        op12_periodic_runs,
        op13_near_vectors,
    )
}
ORACLES: dict[str, str] = {"op6_decontamination": decontaminate.ORACLE, "op10_warc": warc.ORACLE, "op11_centroids": centroids.ORACLE}
