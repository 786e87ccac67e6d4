"""Queries of this subpackage, and SQL where SQL can express them."""

from __future__ import annotations

from . import audit, lexical, licences
from .ann import op2_ann
from .bestfit import op13_bestfit
from .bpe import op5_bpe
from .chat import op9_chat
from .langid import op4_langid
from .media import op3_media
from .packing import op6_packing
from .quality import op7_quality
from .simhash import op1_simhash
from .toxicity import op10_toxicity

QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_ann": op2_ann,
    "op3_media": op3_media,
    "op4_langid": op4_langid,
    "op5_bpe": op5_bpe,
    "op6_packing": op6_packing,
    "op7_quality": op7_quality,
    "op8_licences": licences.op8_licences,
    "op9_chat": op9_chat,
    "op10_toxicity": op10_toxicity,
    "op11_audit": audit.op11_audit,
    "op12_lexical": lexical.op12_lexical,
    "op13_bestfit": op13_bestfit,
}
ORACLES: dict[str, str] = {"op8_licences": licences.sql(), "op11_audit": audit.sql(), "op12_lexical": lexical.sql()}
