"""Limits, word lists, labels and glyph widths that results must agree with."""

# Page geometry (points; fractions of page width or height).
ROT_TOL = 0.01
TOP_ZONE, BASE_ZONE = 0.30, 0.12
REPEAT_FRACTION, REPEAT_LEAST = 0.25, 3
STAMP_X, STAMP_Y = 200.0, 230.0
TOP_STRIP, BASE_STRIP = 78.0, 70.0
CORNER_X, CORNER_Y = 400.0, 95.0
RULER_TOP, RULER_BASE, RULER_WIDTH, RULER_HEIGHT = 0.85, 0.11, 0.45, 3.5
BOX_TOL, BOX_REACH = 5.0, 10.0
THIN, LINE_H, LINE_V, RECT_SIDE, RECT_MOST = 3.5, 24.0, 12.0, 16.0, 0.85
TOUCH, ZONE_EDGE = 3.0, 0.75
BAR_WIDTH, BAR_HEIGHT, BAR_MARGIN = 20.0, 0.50, 0.12
LOSS_TEXT, LOSS_LEAST_CHARS, LOSS_IMAGE = 0.35, 200, 0.10
SHORT_DOC, SHORT_TOP, SHORT_BASE = 4, 0.072, 0.075
PAGE_IMAGE = 0.80
STRIP_GAP = 2.0
COLUMN, COLUMN_DENSITY, COLUMN_SPAN, COLUMN_LEAST = 4.0, 12.0, 0.55, 25
CLUSTER_HEIGHT, CLUSTER_GAP, CLUSTER_LEAST, CLUSTER_MOD = 16.0, 3.5, 3, 99991
HEADER_GAP, HEADER_DROP = 22.0, 4.0
BAND_GAP, BAND_LEAST, BAND_LOW, BAND_HIGH = 3.0, 5, 2.0, 1.2
STROKES = ("S", "s", "B", "B*", "b", "b*")

# Text quality, recognition and classification.
TEXT_LEAST, JUNK_MOST, ALNUM_LEAST = 20, 0.20, 0.45
CONTAINED = 0.80
DENSITY_LEAST = 45.0
REGION_LEAST, REGION_HEADER = 0.02, 0.15
HAND_TEXT, HAND_IMAGE = 40, 0.25
WORD_CONFIDENCE, BLOCK_CONFIDENCE = 40, 60
DPI, LONGEST_PIXELS, CROP_LEAST = 400.0, 5000.0, 8

# Splitting, planning, stamps.
SIZE_MARGIN, MOST_MB = 0.90, 100
WEIGHTS = {"clean": 1.0, "ocr": 2.6, "number": 0.2, "export": 0.4, "split": 0.2}
STAMP_SIZE, STAMP_RIGHT, STAMP_TOP = 10.0, 36.0, 28.0
HEADING_MOST = 60

# Reasons for a removal. The calibrated ones hold inside tables and never count as loss.
CALIBRATED = ("assinatura_rotacionada", "assinatura_vetorial", "carimbo_copia", "tarja_margem")
# What a regression baseline holds: frames, as against cuts and strips.
FRAME_REASONS = (
    "assinatura_rotacionada", "assinatura_vetorial", "carimbo_copia", "cluster_topo", "boiler_texto", "boiler_imagem", "boiler_path",
    "glifo_orfao", "canto_direito", "tarja_margem",
)
# Page classes.
NATIVE, HYBRID, IMAGE_ONLY, CORRUPT = "NATIVA_DIGITAL", "HIBRIDA_COM_OCR", "IMAGEM_SEM_OCR", "TEXTO_CORROMPIDO"
# Labels that open a document part.
HEADINGS = ("DESPACHO", "CERTIDÃO", "CERTIDAO", "PORTARIA", "INFORMAÇÃO", "INFORMACAO", "OFÍCIO", "OFICIO", "PROMOÇÃO", "PROMOCAO", "DECISÃO", "DECISAO", "RELATÓRIO", "RELATORIO", "TERMO DE")
CASE_NUMBER = r"\b\d{2}\.\d{4}\.\d{8}-\d\b"
UNIT_LINE = r"(?im)^[^\n]{0,80}(?:promotoria|procuradoria)[^\n]{0,80}$"
NO_TEXT = "_(página sem texto aproveitável — ative o OCR, com o Tesseract disponível, para extrair o conteúdo)_"
HAND_BANNER = "> **[Documento manuscrito — OCR de baixa confiança, revisar no original]**"
LOW_NOTE = "> _(baixa confiança de OCR — conferir no original)_"
ORIGINS = {"native": "texto nativo", "reused": "camada e-proc reaproveitada", "incomplete": "camada e-proc incompleta — revisar", "ocr": "OCR"}
NOTES = ("LIMPO PRATICAMENTE SEM TEXTO", "limpo perdeu >50% dos chars", "camada e-proc preservada")

# Helvetica glyph widths in thousandths of the font size; others count 556.
WIDTHS = {
    222: "ijl", 191: "'", 260: "|", 278: " !,./:;I[\\]ftíìîÍ", 333: "()-`r", 334: "{}", 355: '"', 389: "*", 469: "^", 500: "Jcksvxyzçñ",
    584: "+<=>~", 611: "FTZ", 667: "&ABEKPSVXYÁÀÃÂÉÊ", 722: "CDHNRUwÚÇ", 778: "GOQÓÔÕ", 833: "Mm", 889: "%", 944: "W", 1015: "@",
}
