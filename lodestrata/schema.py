"""The data model: column sets, nested types, entity registry and enumerations of medical records."""

from __future__ import annotations

from dataclasses import dataclass

# Fixed values of the data model.
QUALIFIED, PENDING, INVALID = "合格", "待复核", "无效"
STATUS = {QUALIFIED: "completed", PENDING: "reviewing", INVALID: "invalid"}
UNKNOWN_DEPARTMENT, UNGRADED, UNKNOWN_MONTH = "未填科室", "未评分", "未知"
GENDERS = ("男", "女", "未知的性别")
AGE_PATTERN = r"^(\d+(\.\d+)?(岁|个月|月|天)?)+$"
SCORE_BUCKETS = ((0, 59), (60, 69), (70, 79), (80, 89), (90, 100))
DATE_COLUMNS = ("visit_time", "create_time")
NARRATIVE = ("western_diagnosis", "tcm_diagnosis", "present_illness", "chief_complaint", "self_report", "inspection", "pulse", "tongue", "physical_exam", "pattern", "prescription", "follow_up", "treatment_effect")
HASHED = ("registration_no", "outpatient_no", "gender", "age", *NARRATIVE, "department", "doctor_id", "visit_count", "visit_time")
#: Spreadsheet headers and the columns that they fill.
HEADERS = {
    "登记号": "registration_no",
    "门诊号": "outpatient_no",
    "性别": "gender",
    "年龄": "age",
    "就诊次数": "visit_count",
    "西医诊断": "western_diagnosis",
    "中医诊断": "tcm_diagnosis",
    "现病史": "present_illness",
    "主诉": "chief_complaint",
    "自诉": "self_report",
    "望诊": "inspection",
    "脉诊": "pulse",
    "舌诊": "tongue",
    "查体": "physical_exam",
    "辨证结论": "pattern",
    "证型": "pattern",
    "草药": "prescription",
    "随访": "follow_up",
    "治疗效果": "treatment_effect",
    "开单科室": "department",
    "医生工号": "doctor_id",
    "接诊时间": "visit_time",
}


@dataclass(frozen=True)
class EntityType:
    """A kind of entity: its key, label, list in the structured document and the raw columns behind it."""

    key: str
    label: str
    field: str
    fallback: tuple[str, ...] = ()


ENTITY_TYPES = (
    EntityType("disease", "疾病", "diseases", ("tcm_diagnosis", "western_diagnosis")),
    EntityType("pattern", "证候", "patternList", ("pattern",)),
    EntityType("symptom", "症状", "symptoms", ("chief_complaint", "self_report", "present_illness")),
    EntityType("herb", "中药", "herbs", ("prescription",)),
    EntityType("formula", "方剂", "formulaList"),
    EntityType("tongue", "舌象", "tongueList", ("tongue",)),
    EntityType("pulse", "脉象", "pulseList", ("pulse",)),
    EntityType("cause", "病因", "causeList"),
)
BY_KEY = {t.key: t for t in ENTITY_TYPES}

ENTITY = "struct<content:string,name:string,dosage:string,sourceText:string,confidence:double,source:string,normLevel:int>"
#: Lists are read as strings first, so a plain-string element or a wrong type never voids the document.
STRUCTURED = "struct<" + ",".join(f"{t.field}:array<string>" for t in ENTITY_TYPES) + ",inquiry:array<string>,_meta:struct<dictVersion:string,dictCapturedAt:string,dictTermCount:int,manuallyEdited:string,editedBy:string,editedAt:string>>"
QC_RESULT = "struct<score:int,grade:string,deductions:array<struct<type:string,item:string,points:int,reason:string>>,logicConflicts:array<string>,structuredMissing:boolean>"
