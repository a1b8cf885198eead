"""Term lists that results depend on. All operators take them as parameters; these are the defaults."""

# The lists below must hold these entries, in this order where a first match wins.

DOSAGE_FORMS = (
    "口腔崩解片", "缓释混悬液", "口服混悬液", "混悬滴剂", "缓释胶囊", "肠溶胶囊", "软胶囊", "肠溶片", "分散片", "缓释片",
    "控释片", "咀嚼片", "泡腾片", "舌下片", "口含片", "薄膜衣片", "干混悬剂", "口服溶液", "口服液", "混悬液", "糖浆", "颗粒",
    "冲剂", "胶囊", "滴丸", "丸", "片", "乳膏", "软膏", "凝胶", "搽剂", "喷雾剂", "气雾剂", "滴眼液", "滴鼻液", "滴耳液",
    "注射液", "注射剂", "贴剂", "栓剂",
)
NON_ORAL_FORMS = ("乳膏", "软膏", "凝胶", "搽剂", "喷雾剂", "气雾剂", "滴眼液", "滴鼻液", "滴耳液", "注射液", "注射剂", "贴剂", "栓剂")
ORAL_WORDS = ("吃", "服用", "口服", "吞服", "同服")
SALT_PREFIXES = ("盐酸", "硫酸", "硝酸", "枸橼酸", "马来酸", "苯磺酸", "甲磺酸", "富马酸", "酒石酸", "琥珀酸", "门冬氨酸", "赖氨酸", "氢溴酸", "磷酸", "醋酸")

# Section names and the words that name them.
IMPORTANT_SECTIONS = ("药物相互作用", "禁忌", "警告与注意事项", "特殊人群", "儿童用药", "老年用药", "孕妇及哺乳期妇女用药")
RERANK_TERMS = ("禁忌", "避免", "不得", "严重", "出血", "低血压", "横纹肌溶解", "乳酸酸中毒")
SECTION_KEYWORDS = (
    ("药物相互作用", ("药物相互作用", "相互作用", "drug interaction", "合用", "联合用药", "配伍")),
    ("禁忌", ("禁忌", "contraindication", "禁忌症", "禁忌证")),
    ("警告与注意事项", ("警告", "注意事项", "warning", "precaution", "慎用")),
    ("不良反应", ("不良反应", "副作用", "adverse", "side effect")),
    ("用法用量", ("用法用量", "用法", "用量", "dosage", "剂量")),
    ("特殊人群", ("特殊人群", "老年", "儿童", "妊娠", "哺乳", "肝功能", "肾功能")),
)

# Strong and mild words of evidence and of sections.
EVIDENCE_HIGH = ("禁忌", "严重", "不得", "避免合用", "显著增加", "危及生命", "横纹肌溶解", "严重低血压", "禁止", "危险", "致死", "避免与")
EVIDENCE_MEDIUM = ("监测", "谨慎", "调整剂量", "增加风险", "可能", "注意", "肾功能", "出血", "减量", "慎用")

SECTION_HIGH = ("禁用", "禁忌", "严禁", "禁止", "不得", "避免合用", "避免使用", "严禁并用")
SECTION_MEDIUM = ("慎用", "需注意", "应注意", "监测", "调整剂量", "减量", "风险增加", "风险增高", "不宜", "医师指导", "医生指导", "药师指导", "专业医师指导", "遵医嘱", "成人监护")
ACTION_WORDS = ("慎用", "风险增加", "风险增高", "调整剂量", "减量", "医师指导", "医生指导", "药师指导", "遵医嘱")
NON_ACTIONABLE = ("无特别注意事项", "无特殊要求", "无特殊注意", "尚不明确", "尚未明确", "尚无资料", "资料不详", "未进行该项实验", "未进行相关研究")

# Words of a question that name groups, conditions and risks.
POPULATION_WORDS = (
    ("老年", "老年人"), ("老人", "老年人"), ("高龄", "老年人"), ("孕", "妊娠/备孕"), ("哺乳", "哺乳期"), ("儿童", "儿童"), ("婴幼儿", "儿童"),
    ("小儿", "儿童"), ("肾", "肾功能相关"), ("肝", "肝功能相关"), ("透析", "肾功能相关"), ("心衰", "心力衰竭"),
)
CONDITION_WORDS = (
    "高血压", "糖尿病", "房颤", "心房颤动", "感染", "感冒", "冠心病", "冠脉", "肾功能不全", "肝功能不全", "心衰", "心力衰竭", "高血脂",
    "高脂血症", "哮喘", "痛风", "肠胃炎", "胃肠炎", "胃炎", "肠炎", "消化道溃疡",
)
RISK_FACTOR_WORDS = ("出血", "抗凝", "低血压", "高钾", "低钾", "肾功能", "肝功能", "肌痛", "肌无力", "横纹肌", "过敏", "胃肠道", "消化道", "胃痛", "腹痛")

# The patterns of negations, with the characters after one in which a name counts as negated, of two listed
# words, and of ages.
NEGATIONS = (
    (r"(?:没有|没|不|未|拒绝)\s*(?:在\s*)?(?:服用|使用|吃[了]?|用[了]?|打|注射|口服)", 6),
    (r"(?:不能|不可|禁止)\s*(?:同时\s*)?(?:服用|使用|吃|用|合用)", 6),
    (r"(?:停[了]?|停止|暂停)\s*(?:服用|使用|吃|用)", 5),
    (r"(?:停[了]?|停止|暂停)", 6),
    (r"(?:不\s*(?:需要|建议|推荐|应该)\s*(?:服用|使用|吃|用))", 6),
)
COMBINATION = r"(?U)([一-鿿\w]+)\s*(?:和|与|及|、|,|，|\+)\s*([一-鿿\w]+)"
AGE = r"(?<![\d.])(\d{1,3}|[零〇一二两三四五六七八九十百]{1,8})\s*(?:岁|周岁|岁半|周岁半)"

# Tags, classes and risk events by their words.
POPULATION_TAGS = (
    ("儿童", ("儿童", "小儿", "婴幼儿", "新生儿", "18岁以下", "18 岁以下")),
    ("老年人", ("老人", "老年", "高龄")),
    ("妊娠/备孕", ("孕妇", "妊娠", "孕期", "备孕", "胎儿")),
    ("哺乳期", ("哺乳", "乳汁", "乳母")),
)
CONDITION_TAGS = (
    ("肝功能不全", ("肝功能不全", "肝功能障碍", "严重肝", "活动性肝病")),
    ("肾功能不全", ("肾功能不全", "肾功能障碍", "严重肾", "透析")),
    ("消化道出血/溃疡", ("消化道出血", "胃肠道出血", "消化道溃疡", "胃溃疡", "活动性出血")),
    ("过敏", ("过敏", "过敏史")),
    ("心力衰竭", ("心力衰竭", "心衰")),
    ("哮喘", ("哮喘",)),
    ("糖尿病", ("糖尿病",)),
)
DRUG_CLASSES = (
    ("抗凝药", ("抗凝药", "华法林", "肝素")),
    ("抗血小板药", ("抗血小板", "阿司匹林", "氯吡格雷")),
    ("NSAIDs", ("NSAIDs", "非甾体抗炎药", "解热镇痛药")),
    ("CYP3A4抑制剂", ("CYP3A4抑制剂", "CYP3A4 抑制剂")),
    ("CYP2D6抑制剂", ("CYP2D6抑制剂", "CYP2D6 抑制剂")),
    ("CYP2C19抑制剂", ("CYP2C19抑制剂", "CYP2C19 抑制剂")),
    ("MAOIs", ("MAOIs", "单胺氧化酶抑制剂")),
    ("中枢抑制药", ("中枢抑制药", "镇静催眠药", "酒精")),
)
RISK_EVENTS = (
    ("出血", ("出血", "INR")),
    ("低血压", ("低血压",)),
    ("高钾血症", ("高钾", "血钾")),
    ("肝损伤", ("肝损害", "肝损伤", "转氨酶")),
    ("肾损伤", ("肾损害", "肾损伤", "肾功能恶化")),
    ("横纹肌溶解", ("横纹肌溶解", "肌病", "肌痛")),
    ("骨髓抑制", ("骨髓抑制", "白细胞减少", "血小板减少")),
    ("过敏反应", ("过敏反应", "休克", "荨麻疹")),
)
SAFETY_SECTIONS = ("禁忌", "警告与注意事项", "孕妇及哺乳期妇女用药", "儿童用药", "老年用药", "药物相互作用")
SHORT_SECTIONS = ("禁忌", "孕妇及哺乳期妇女用药", "儿童用药", "老年用药")

# The words by which evidence is about a group or a condition, strong and mild ones.
POPULATION_MATCH = (
    ("老年人", ("老年", "老人", "老年患者", "高龄", "65岁", "65 岁")),
    ("儿童", ("儿童", "小儿", "婴幼儿", "18岁以下", "18 岁以下", "儿科")),
    ("妊娠/备孕", ("妊娠", "孕妇", "孕期", "备孕", "胎儿")),
    ("哺乳期", ("哺乳", "乳汁", "婴儿")),
    ("肾功能相关", ("肾功能", "肾功能不全", "eGFR", "透析")),
    ("肝功能相关", ("肝功能", "肝功能不全", "转氨酶")),
    ("心力衰竭", ("心力衰竭", "心衰")),
)
POPULATION_HIGH = ("禁用", "禁止", "禁忌", "不得", "避免", "原则上禁用", "致畸", "不应使用", "胎儿死亡", "胎儿危害", "胎儿损伤")
POPULATION_MEDIUM = (
    "慎用", "风险增高", "风险更高", "应监测", "监测", "减量", "调整剂量", "起始剂量", "不宜", "医师指导", "医生指导", "药师指导", "专业医师指导",
    "遵医嘱", "成人监护", "剂量选择", "低剂量", "小剂量", "清除率", "AUC", "肝功能", "肾功能", "心功能", "合用其他药物",
)
CONDITION_MATCH = (
    ("高血压", ("高血压", "血压")),
    ("糖尿病", ("糖尿病", "血糖")),
    ("肾功能不全", ("肾功能不全", "肾功能", "肾病", "eGFR")),
    ("肝功能不全", ("肝功能不全", "肝功能", "肝病", "转氨酶")),
    ("心力衰竭", ("心力衰竭", "心衰", "心功能不全")),
    ("冠心病", ("冠心病", "心脏病")),
)
CONDITION_HIGH = ("禁用", "禁止", "禁忌", "不得", "避免", "不应使用", "严重")
CONDITION_MEDIUM = ("慎用", "医师指导", "医生指导", "药师指导", "监测", "评估", "调整剂量", "剂量调整", "风险", "不宜")

# Fixed value: a line that opens a section, 【title】, a numbered short line, or a short line that ends in a colon.
HEADING = r"(?m)(?:^|\n)\s*(?:【([^】]+)】|(\d+[.、]\s*[^\n]{2,20})|([^\n]{2,15})[：:]\s*$)"
# Wording by level; without a level it depends on whether ambiguous names were found.
RECOMMENDATIONS = {
    "High": "不建议自行合用或调整剂量，请尽快咨询医生或药师，并留意出血、低血压、过敏等异常表现。",
    "Medium": "可以作为风险线索处理，但需结合剂量、频次、肝肾功能和其他用药，由专业人员确认。",
    "Low": "当前证据未提示明确严重相互作用，但仍建议按说明书和医嘱使用。",
    "ambiguous": "目前存在未明确的药品名称，建议先补充具体药品名称后再判断。",
    "other": "建议补充具体药品名称后再判断，必要时咨询医生或药师。",
}
CONCLUSIONS = {
    "pair": "{left} 与 {right} 存在 {level} 级用药风险。",
    "Unknown": "证据不足，暂不能给出确定性用药安全结论。",
    "other": "基于当前上下文、知识图谱关系和检索证据，综合风险等级为 {level}。",
}

# Ranks of levels, and what relations of a graph are called and mean.
RISK_RANK = {"Unknown": 0, "Low": 1, "Medium": 2, "High": 3}
KG_HIGH = ("禁忌合用", "禁用于", "CONTRAINDICATED_WITH", "CONTRAINDICATED_FOR")
KG_MEDIUM = ("慎用于", "检查注意", "USE_WITH_CAUTION_IN", "CAUTION_FOR", "EXAM_CAUTION")
RELATION_LABELS = {
    "INTERACTS_WITH": "相互作用", "BELONGS_TO": "属于", "CONTRAINDICATED_FOR": "禁用于", "CONTRAINDICATED_WITH": "禁忌合用",
    "USE_WITH_CAUTION_IN": "慎用于", "CAUTION_FOR": "慎用于", "COMMON_DRUG": "常用药", "MAY_CAUSE": "风险", "MONITOR": "监测指标", "EXAM_CAUTION": "检查注意",
}

# What a question about a group asks for besides.
POPULATION_QUERY = (
    ("老年人", ("老年", "老人", "老年患者", "高龄", "65岁", "65 岁", "特殊人群", "风险增高", "风险更高", "剂量选择", "清除率", "AUC", "小剂量")),
    ("儿童", ("儿童", "小儿", "婴幼儿", "18岁以下", "18 岁以下", "儿科", "特殊人群", "禁用", "慎用")),
    ("妊娠/备孕", ("妊娠", "孕妇", "孕期", "备孕", "胎儿", "特殊人群", "禁用", "慎用")),
    ("哺乳期", ("哺乳", "乳汁", "婴儿", "特殊人群", "禁用", "慎用")),
    ("肾功能相关", ("肾功能", "肾功能不全", "eGFR", "透析", "剂量调整", "特殊人群")),
    ("肝功能相关", ("肝功能", "肝功能不全", "转氨酶", "减量", "特殊人群")),
    ("心力衰竭", ("心力衰竭", "心衰", "水肿", "慎用", "禁用")),
)
POPULATION_TITLES = (
    ("老年人", ("老年用药", "特殊人群", "警告与注意事项")),
    ("儿童", ("儿童用药", "特殊人群", "警告与注意事项")),
    ("妊娠/备孕", ("孕妇及哺乳期妇女用药", "妊娠", "特殊人群", "警告与注意事项")),
    ("哺乳期", ("孕妇及哺乳期妇女用药", "哺乳", "特殊人群", "警告与注意事项")),
    ("肾功能相关", ("肾功能", "特殊人群", "警告与注意事项", "用法用量")),
    ("肝功能相关", ("肝功能", "特殊人群", "警告与注意事项", "用法用量")),
    ("心力衰竭", ("心力衰竭", "心衰", "警告与注意事项", "禁忌")),
)
POPULATION_QUERY_TAIL = ("特殊人群", "用药前确认", "禁忌", "注意事项", "用法用量")

# The wording of safety flags by code, and of the flag of a family of candidates.
FLAG_MESSAGES = {
    "high_risk": "存在高风险或禁忌线索，不建议自行合用。",
    "no_evidence": "未召回足够说明书/指南证据，结论已降级处理。",
    "few_concepts": "当前上下文少于两个明确药物，无法完整评估相互作用。",
    "ambiguous_rated": "{names}未识别为明确药品，未纳入本次相互作用计算。",
    "ambiguous": "{names}不是明确的具体药品名称，请补充具体名称后再判断。",
}
FAMILY_MESSAGE = "“{mention}”已按药物家族展开为 {candidates} 个相关制剂，本次基于其中 {with_evidence} 个制剂召回到的说明书证据进行综合判断。"

# The wording of a chain's mechanisms, of a single report with its limitations, and of an answer's parts.
MECHANISMS = {
    "ambiguous": "当前问题包含口语化、类别或复方药品表达，无法作为具体药品组合进行精确相互作用判断。",
    "few": "当前问题中少于两个明确药物，无法对药物相互作用做确定性判断。",
    "no_names": "当前问题中未识别到明确药物，无法进行个体化用药风险判断。",
    "pair": "存在已知药物相互作用。",
    "pair_advice": "建议由医生或药师确认是否需要调整治疗方案。",
    "no_evidence": "当前知识库未检索到足够证据，不能做确定性判断。",
    "High": "检索证据包含禁忌、严重不良反应或明确避免合用信息。",
    "Medium": "检索证据提示可能需要监测、谨慎使用或调整剂量。",
    "Low": "当前证据未提示明确严重相互作用，但仍需结合患者情况判断。",
    "population_high": "检索证据提示该药在{names}相关场景中存在禁用、禁忌或应避免使用等限制。",
    "population_medium": "检索证据提示{names}用药时风险可能增高，需谨慎使用、监测或由医生药师确认。",
    "condition": "检索证据提示合并{names}时需谨慎使用、监测或由医生药师确认。",
    "graph": "知识图谱校验命中结构化关系：{subject} - {relation} - {object}。",
    "also": " 同时，",
    "nothing": "当前本地知识库和向量检索未找到足够证据，不能做确定性判断。",
}
REPORT = {
    "Unknown": "未找到足够可靠证据，系统不做安全性结论。",
    "Unknown_advice": "建议补充完整药物名称、剂量、疾病和特殊人群信息，并咨询医生或药师。",
    "pair": "{left} 与 {right} 存在 {level} 级用药风险。",
    "pair_advice": "建议由医生或药师评估是否调整治疗方案，并进行必要监测。",
    "other": "基于当前知识库证据，综合风险等级为 {level}。",
    "other_advice": "建议结合患者病史、剂量、肝肾功能和正在使用的其他药物，由专业人员确认。",
}
LIMITATIONS = {
    "few": "输入中少于两个可识别药物，药物相互作用判断可能不完整。",
    "no_evidence": "当前本地知识库未召回相关说明书片段。",
    "no_dose": "输入缺少剂量信息，无法评估剂量相关风险。",
}
ANSWER = {
    "mechanism": "原因：{mechanism}",
    "recommendation": "建议：{recommendation}",
    "graph": "图谱关系：{subject} - {relation} - {object}。",
    "evidence": "主要证据：{drug}/{section} 提到“{snippet}”。",
    "flags": "安全提示：{flags}",
    "between": "；",
    "notice": "本系统用于用药风险信息检索与咨询辅助，不提供诊断、处方或替代医生/药师的医疗建议。",
}
