"""Parameters and vocabularies of retrieval and extraction."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    top_k: int = 4
    vector_min: float = 0.45
    keyword_min: float = 7.0
    fused_min: float = 0.62
    vague_max: float = 0.60
    vector_weight: float = 0.45
    keyword_weight: float = 0.55
    squash: float = 8.0
    k1: float = 1.5
    b: float = 0.75
    basis_penalty: float = 0.72
    tie: float = 0.01
    most: float = 0.9999
    enrich_cap: float = 0.999
    history_turns: int = 5
    history_chars: int = 3000
    question_chars: int = 1000
    chunk_size: int = 500
    chunk_overlap: int = 100
    snippet: int = 120
    hint_least: int = 6


DEFAULTS = Params()

# Vocabularies of the corpus, which results depend on.
SECTION_NAMES = ["网上办理流程", "线下办理流程", "受理范围", "受理条件", "材料清单", "办理流程", "收费标准", "收费信息", "实施依据", "设定依据", "咨询方式", "审批信息", "基础信息", "常见问题", "温馨提示"]
STRUCTURED_SECTIONS = ["必备材料", "可选材料", "材料清单", "材料名称", "办理流程", "网上办理流程", "线下办理流程", "基础信息", "审批信息", "受理条件", "受理范围", "受理部门", "承诺时限", "收费标准", "收费信息", "办理渠道", "注意事项", "温馨提示"]
MATERIAL_SECTIONS = ["材料清单", "必备材料", "可选材料", "申请材料", "材料名称"]
BASIS_SECTIONS = ["实施依据", "设定依据", "法律依据", "政策依据"]
BASIS_QUESTION = ["依据", "法规", "条例", "文号", "根据"]
# Fixed values: (words of a question, parts of a section's name, boost)
INTENTS = [
    (["材料", "清单", "需要", "哪些", "准备", "带什么", "提交"], ["材料清单", "必备材料", "可选材料", "申请材料", "材料名称"], 1.35),
    (["流程", "步骤", "怎么办理", "如何办理", "怎么办", "如何办", "程序", "网上办"], ["办理流程", "网上办理流程", "线下办理流程", "审批信息"], 1.35),
    (["时限", "多久", "几天", "几个工作日", "什么时候", "办结"], ["基础信息", "审批信息", "办理流程", "承诺时限"], 1.22),
    (["收费", "多少钱", "费用", "要钱吗", "免费"], ["收费信息", "收费标准", "基础信息"], 1.30),
    (["条件", "资格", "能不能", "符合", "要求"], ["受理条件", "受理范围"], 1.30),
    (["部门", "哪里办", "在哪", "哪个部门", "地址", "窗口", "咨询"], ["受理部门", "咨询方式", "基础信息"], 1.30),
    (["依据", "根据", "法规", "条例", "文号", "政策文件"], ["实施依据", "设定依据"], 1.35),
]
# Fixed values: (words of a question, the term to add)
SYNONYMS = [
    (["续期", "到期", "延期", "续签", "换证", "过期"], "签注"),
    (["过户", "二手房", "买卖房屋"], "转移登记"),
    (["营业执照", "开店", "开公司"], "设立登记"),
    (["改名", "更名", "换名", "改字号", "换字号"], "变更登记"),
    (["不想开", "不开了", "不干了", "不经营", "关门", "歇业", "停业", "倒闭", "注销"], "注销登记"),
]
# Words of questions that ask for structured facts.
STRUCTURED_INTENT = [
    "材料", "清单", "需要", "哪些", "准备", "流程", "步骤", "怎么办", "如何办", "怎么办理", "如何办理", "在哪办", "怎么",
    "时限", "多久", "几天", "工作日", "办结", "什么时候", "收费", "多少钱", "费用", "要钱吗", "免费", "条件", "资格", "能不能", "符合",
    "部门", "哪里办", "在哪", "哪个部门", "地址", "窗口", "咨询", "依据", "法规", "条例", "文号",
    "办什么", "要办", "办理", "办哪些", "手续", "申请", "申领", "登记",
]
# Words that name what a question is about.
ENTITY_HINTS = [
    "居住证", "签注", "社保", "养老", "保险", "补贴", "资助", "创业", "就业", "失业", "退休", "工伤", "生育", "医疗", "医保", "公积金",
    "营业执照", "个体", "公司", "企业", "开店", "门市", "店铺", "店", "注销", "变更", "设立", "过户", "房屋", "房产", "不动产", "宅基地", "土地",
    "户籍", "户政", "身份证", "结婚", "结婚证", "离婚", "出生", "公证", "税务", "发票", "护照", "港澳", "通行证", "出境", "入境",
    "教师资格", "资格认定", "老师", "教师", "公共场所", "卫生许可", "食品经营", "公租房", "保障房", "保障性住房", "租赁", "住房", "租房", "提取", "贷款",
    "社保卡", "社会保障卡", "一卡通", "制卡", "领卡", "驾驶证", "驾照", "换证", "机动车", "车牌", "上牌", "车辆",
    "异地就医", "就医", "备案", "转移接续", "入户", "落户", "户口", "人才引进",
]
# What cleaning keeps as it is, where blocks of place names begin and end, and what page marks look like.
KEPT_PUNCTUATION = "，。；：！？、（）《》【】“‘’”…—"
SKIP_START = "跨域通办"
SKIP_ENDS = ["基础信息", "审批信息", "受理范围", "受理条件", "材料清单", "网上办理流程", "线下办理流程", "办理流程", "收费标准", "收费信息", "实施依据", "设定依据", "咨询方式", "申请材料", "办理时限"]
SKIP_LINES = 400
PAGE_LINES = [
    r"\s*第\s*[0-9一二三四五六七八九十百千]+\s*页\s*",
    r"\s*[0-9]+\s*/\s*共?\s*[0-9]+\s*页?\s*",
    r"\s*[-—]{2,}\s*[0-9]+\s*[-—]{2,}\s*",
    r"\s*[-—_.·]{3,}\s*[0-9]+\s*[-—_.·]{3,}\s*",
    r"\s*(页眉|页脚|内部资料|仅供参考)\s*[:：]?\s*",
]
# Names that are headers or values of a table's cells, and parts that no name has.
NOISE_NAMES = ["名称", "类型", "材料名称", "材料依据", "材料形式", "材料要求", "材料下载", "材料类型", "其他信息", "纸质材料规格", "是否免提交", "填报须知", "示例样本", "空白表格", "已关联电子证照", "原件", "复印件", "必要", "非必要", "纸质", "电子化", "证照", "其他", "份数", "页数", "来源渠道", "备注", "说明", "无", "否", "是", "暂无", "中介服务"]
NOISE_PARTS = ["地方特色主题分类", "事项主题分类", "表示该材料", "中介服务", "备注信息", "服务对象", "受理范围", "面向自然人", "面向法人", "已关联电子证照"]
NOISE_ROWS = ["空白表格", "示例样本", "填报须知", "其他要求", "备注", "说明", "名称", "类型", "材料名称", "材料依据", "材料形式", "材料要求", "材料下载", "其他信息", "序号", "份数", "页数", "来源渠道", "中介服务"]
ROW_MARKS = ["原件", "复印件", "纸质", "电子化", "必要", "非必要", "已关联电子证照", "该材料免提交", "材料类型", "材料形式", "来源渠道", "是否免提交", "纸质材料规格"]
TABLE_SIGNAL = "原件[：:]|复印件[：:]|纸质/电子化|已关联电子证照|该材料免提交"
MATERIAL_LEADS = ["应提交材料", "需提交材料", "提交材料", "申请材料", "所需材料", "提交以下材料"]
MATERIAL_STOPS = ["应核验信息", "核验信息", "申请程序", "办理程序", "注意事项", "温馨提示", "补贴标准", "补贴对象", "补贴期限", "申领期限", "申领流程"]
STEP_STOPS = ["服务对象", "事项主题分类", "面向自然人", "面向法人", "自然人", "法人", "其他主体", "社会组织", "受理范围", "办理地点", "审批信息", "基础信息", "实施依据", "其他信息", "日常用语", "事项类型"]
# What is said where there is no answer.
NO_HIT, UNAVAILABLE = "知识库中未找到相关内容。", "检索服务暂时不可用，请稍后重试。"
