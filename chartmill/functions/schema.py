"""Key universes and label tables. Values that results depend on are fixed values, stated as text."""

from __future__ import annotations

# Typed keys of an event.
DATE_KEYS = ("Timestamp",)
NUMBER_KEYS = ("TumorSize", "PDL1", "PETCT", "RadiationDose", "RadiationFractions")
INTEGER_KEYS = ("TumorSize", "RadiationFractions")
LIST_KEYS = (
    "ProcedureDiagnosis", "Site", "TNM_T", "TNM_N", "SitesOfMetastasis", "TNM_M", "Stage", "Recurrence", "SiteOfRecurrence", "HistologicalGrading",
    "Reaction", "ToxicityGrade", "Cytology", "TBB", "TBLB", "EBUS_TBNA", "Oncomine", "TTF1", "p40", "p63", "CK5_6", "NapsinA", "EGFR", "ALK", "ROS1",
    "RET", "BRAF", "KRAS", "HER2", "PathologicalExamination", "AssessedAnatomicSite", "NTRK", "NGS", "ROSE", "Treatment",
)
#: Keys whose null or empty value gives no atom.
SILENT_KEYS = ("Timestamp", "Site")
#: Keys under which scoring reads another key.
EVAL_ALIASES = {"TBB": "TBB_TBLB", "TBLB": "TBB_TBLB"}
#: Keys that are scored but not reported, and keys that prompts leave out.
UNREPORTED_KEYS = ("p63", "Reaction", "ToxicityGrade")
UNPROMPTED_KEYS = ("Reaction", "ToxicityGrade")

KEY_TYPES = {k: "date" for k in DATE_KEYS} | {k: "number" for k in NUMBER_KEYS} | {k: "list" for k in LIST_KEYS}
EVAL_KEYS = tuple(sorted({EVAL_ALIASES.get(k, k) for k in KEY_TYPES}))
PROMPT_KEYS = tuple(sorted(set(KEY_TYPES) - set(UNPROMPTED_KEYS)))
REPORTED_KEYS = tuple(k for k in EVAL_KEYS if k not in UNREPORTED_KEYS)

# Canonical label -> (side, region, histology, special).
DIAGNOSES: dict[str, tuple[str | None, str | None, str | None, str | None]] = {
    "右上葉肺腺がん": ("右", "上葉", "腺がん", None),
    "右上葉肺扁平上皮がん": ("右", "上葉", "扁平上皮がん", None),
    "右上葉肺小細胞がん": ("右", "上葉", "小細胞がん", None),
    "右上葉肺大細胞がん": ("右", "上葉", "大細胞がん", None),
    "右上葉肺がん": ("右", "上葉", None, None),
    "右中葉肺腺がん": ("右", "中葉", "腺がん", None),
    "右中葉肺扁平上皮がん": ("右", "中葉", "扁平上皮がん", None),
    "右中葉肺小細胞がん": ("右", "中葉", "小細胞がん", None),
    "右中葉肺大細胞がん": ("右", "中葉", "大細胞がん", None),
    "右中葉肺がん": ("右", "中葉", None, None),
    "右下葉肺腺がん": ("右", "下葉", "腺がん", None),
    "右下葉肺扁平上皮がん": ("右", "下葉", "扁平上皮がん", None),
    "右下葉肺小細胞がん": ("右", "下葉", "小細胞がん", None),
    "右下葉肺大細胞がん": ("右", "下葉", "大細胞がん", None),
    "右下葉肺がん": ("右", "下葉", None, None),
    "左上葉肺腺がん": ("左", "上葉", "腺がん", None),
    "左上葉肺扁平上皮がん": ("左", "上葉", "扁平上皮がん", None),
    "左上葉肺小細胞がん": ("左", "上葉", "小細胞がん", None),
    "左上葉肺大細胞がん": ("左", "上葉", "大細胞がん", None),
    "左上葉肺がん": ("左", "上葉", None, None),
    "左下葉肺腺がん": ("左", "下葉", "腺がん", None),
    "左下葉肺扁平上皮がん": ("左", "下葉", "扁平上皮がん", None),
    "左下葉肺小細胞がん": ("左", "下葉", "小細胞がん", None),
    "左下葉肺大細胞がん": ("左", "下葉", "大細胞がん", None),
    "左下葉肺がん": ("左", "下葉", None, None),
    "右肺門部肺腺がん": ("右", "肺門部", "腺がん", None),
    "右肺門部肺扁平上皮がん": ("右", "肺門部", "扁平上皮がん", None),
    "右肺門部肺小細胞がん": ("右", "肺門部", "小細胞がん", None),
    "右肺門部肺大細胞がん": ("右", "肺門部", "大細胞がん", None),
    "右肺門部肺がん": ("右", "肺門部", None, None),
    "左肺門部肺腺がん": ("左", "肺門部", "腺がん", None),
    "左肺門部肺扁平上皮がん": ("左", "肺門部", "扁平上皮がん", None),
    "左肺門部肺小細胞がん": ("左", "肺門部", "小細胞がん", None),
    "左肺門部肺大細胞がん": ("左", "肺門部", "大細胞がん", None),
    "左肺門部肺がん": ("左", "肺門部", None, None),
    "右肺腺がん": ("右", None, "腺がん", None),
    "右肺扁平上皮がん": ("右", None, "扁平上皮がん", None),
    "右肺小細胞がん": ("右", None, "小細胞がん", None),
    "右肺大細胞がん": ("右", None, "大細胞がん", None),
    "右肺がん": ("右", None, None, None),
    "左肺腺がん": ("左", None, "腺がん", None),
    "左肺扁平上皮がん": ("左", None, "扁平上皮がん", None),
    "左肺小細胞がん": ("左", None, "小細胞がん", None),
    "左肺大細胞がん": ("左", None, "大細胞がん", None),
    "左肺がん": ("左", None, None, None),
    "肺腺がん": (None, None, "腺がん", None),
    "肺扁平上皮がん": (None, None, "扁平上皮がん", None),
    "肺小細胞がん": (None, None, "小細胞がん", None),
    "肺大細胞がん": (None, None, "大細胞がん", None),
    "肺がん": (None, None, None, None),
    "肺がん疑い": (None, None, None, "肺がん疑い"),
    "肺がん骨転移": (None, None, None, "肺がん骨転移"),
    "その他": (None, None, None, "その他"),
}
