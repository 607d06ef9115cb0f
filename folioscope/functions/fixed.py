"""Word lists, lookup tables and limits that results must agree on."""

# --- Fixed values: retrieval and context limits -----------------------------------
RRF_K = 60
ROUTE_TOPK = 40
FUSED_LIMIT = 30
ASK_LIMIT = 12
PER_SUBQUERY_LIMIT = 10
INTERLEAVE_CAP = 72
SUBQUERY_CAP = 16
CONTEXT_CHARS = 24_000
ANALYSIS_CONTEXT_CHARS = 82_000
EXTRACTION_CHARS = 30_000
BM25_K1 = 1.2
BM25_B = 0.75
BM25_MIN_IDF = 1e-6

# --- Fixed values: chunking -------------------------------------------------------
TARGET_TOKENS = 1000
OVERLAP_TOKENS = 120
MAX_TOKENS = 1400
MIN_TOKENS = 50
CHARS_PER_TOKEN = 1.6

# --- Fixed values: catalogue ------------------------------------------------------
LANG_ZH_SHARE = 0.2
MAX_INSTITUTION_CHARS = 12
FUTURE_TOLERANCE_DAYS = 7
CATEGORY_KEYWORDS = ["国内券商报告", "投行报告"]
UNKNOWN_INSTITUTION = "未知"
REASON_INSTITUTION_SUSPECT = "机构解析存疑（疑似含标题）"
REASON_INSTITUTION_MISSING = "机构未能从文件名解析"
REASON_DATE_MISSING = "report_date 未能解析"
REASON_DATE_MALFORMED = "report_date 格式非法"
REASON_CATEGORY_MISSING = "category 未能从路径匹配"
DATE_OVERRIDES = {"c676069b5f3928eb763a50a3efabeca6": "2026-07-30"}

# --- Fixed values: timelines and drift --------------------------------------------
TIMELINE_LIMIT = 200
TOP_THEMES_LIMIT = 30
SUBCATEGORY_LIMIT = 12
INSTITUTION_FLOOR = 3
UNKNOWN_BUCKET = "未知"
SLUG_CHARS = 40
DRIFT_MIN_DOCS = 8
DRIFT_MIN_INSTITUTIONS = 3
DRIFT_RECENT_DAYS = 60
DRIFT_MIN_LIFT = 2.5
DRIFT_SAMPLES = 5
DRIFT_STOP_TAGS = [
    "出海", "国产替代", "高股息", "并购重组", "货币政策", "宏观经济",
    "通胀", "信用债", "利率债", "数据要素", "消费", "银行", "券商",
    "ETF", "A股策略", "大类资产配置", "行业轮动", "北交所", "港股", "A股",
]
LEGACY_CHAIN_NAMES = [
    "AIDC", "人工智能", "人形机器人", "储能", "军工", "农业", "创新药",
    "化工", "医药", "固态电池", "国产算力", "大模型", "数据要素",
    "新能源", "新能源车", "有色", "机器人", "石油石化", "算力", "芯片",
]
CANDIDATE_STATES = ["watching", "merged", "rejected"]

# --- Fixed values: amounts (unit -> multiple of the base currency unit) -----------
AMOUNT_BASE = 1e8
AMOUNT_UNITS = {
    "亿元": {
        "万元": 1e4, "十万元": 1e5, "百万元": 1e6, "千万元": 1e7,
        "亿元": 1e8, "十亿元": 1e9, "百亿元": 1e10, "万亿元": 1e12,
    },
    "亿美元": {
        "万美元": 1e4, "百万美元": 1e6, "千万美元": 1e7, "亿美元": 1e8,
        "十亿美元": 1e9, "百亿美元": 1e10, "万亿美元": 1e12,
    },
    "亿港元": {"万港元": 1e4, "百万港元": 1e6, "亿港元": 1e8},
}
SCALE_WORDS = {
    "万亿": 1e12, "千亿": 1e11, "百亿": 1e10, "十亿": 1e9, "亿": 1e8,
    "千万": 1e7, "百万": 1e6, "十万": 1e5, "万": 1e4,
    "bn": 1e9, "mn": 1e6, "k": 1e3,
}
SPOT_METRICS = ["目标价", "现价", "股价", "收盘价", "目标价/现价", "目标价格"]
AS_OF_MAX_MONTHS = 3

# --- Fixed values: entity aliases (canonical name -> every spelling) --------------
ENTITY_ALIASES = {
    "台积电": ["台积电", "TSMC", "tsmc", "台積電"],
    "三星电子": ["三星电子", "三星", "Samsung Electronics", "Samsung", "삼성전자"],
    "地平线": ["地平线", "Horizon Robotics", "地平线机器人"],
    "英伟达": ["英伟达", "NVIDIA", "Nvidia", "nvidia", "英偉達"],
    "阿里巴巴": ["阿里巴巴", "Alibaba", "BABA", "阿里"],
    "腾讯控股": ["腾讯控股", "腾讯", "Tencent"],
    "美光科技": ["美光科技", "美光", "Micron", "Micron Technology"],
    "台达电子": ["台达电子", "台达", "Delta", "Delta Electronics"],
    "联发科": ["联发科", "MediaTek", "聯發科"],
    "布伦特原油": ["布伦特原油", "布伦特", "Brent", "Brent原油", "布兰特"],
    "WTI原油": ["WTI原油", "WTI", "西德州原油", "美国原油"],
    "美联储": ["美联储", "Fed", "FED", "联邦储备"],
    "谷歌": ["谷歌", "Google", "Alphabet"],
    "微软": ["微软", "Microsoft", "MSFT"],
    "苹果": ["苹果", "Apple", "AAPL"],
    "亚马逊": ["亚马逊", "Amazon", "AMZN"],
    "特斯拉": ["特斯拉", "Tesla", "TSLA"],
    "宁德时代": ["宁德时代", "CATL", "宁德"],
    "比亚迪": ["比亚迪", "BYD"],
    "贵州茅台": ["贵州茅台", "茅台", "600519"],
}

# --- Fixed values: segment names (noise words, synonym groups) --------------------
SEGMENT_NOISE = [
    "产业链", "环节", "板块", "领域", "方向", "相关", "厂商", "企业",
    "制造", "生产", "行业",
]
SEGMENT_SYNONYMS = {
    "光模块": ["光模块", "光通信模块", "optical module", "optical transceiver", "光收发模块", "opticalmodules"],
    "cpo": ["cpo", "共封装光学", "co-packaged optics", "光电共封装"],
    "ai服务器": ["ai服务器", "人工智能服务器", "ai server", "整机", "服务器整机"],
    "液冷": ["液冷", "液体冷却", "液冷散热", "liquid cooling", "散热", "温控", "液冷温控"],
    "算力芯片": ["算力芯片", "ai芯片", "ai算力芯片", "gpu", "ai accelerator", "加速卡", "ai chip"],
    "存储芯片": ["存储芯片", "存储器", "hbm", "dram", "nand", "memory", "高带宽内存"],
    "半导体设备": ["半导体设备", "晶圆制造设备", "前道设备", "semiconductor equipment", "wafer fab equipment"],
    "半导体材料": ["半导体材料", "电子材料", "semiconductor material"],
    "cmp抛光材料": ["cmp抛光材料", "cmp材料", "抛光液", "抛光垫", "cmp"],
    "光刻胶": ["光刻胶", "photoresist", "光阻"],
    "电子特气": ["电子特气", "电子特种气体", "特种气体", "electronic specialty gas"],
    "湿电子化学品": ["湿电子化学品", "湿化学品", "wet chemicals"],
    "eda": ["eda", "eda工具", "ip", "eda/ip", "设计工具", "electronic design automation"],
    "先进封装": ["先进封装", "advanced packaging", "chiplet", "2.5d", "3d封装"],
    "晶圆代工": ["晶圆代工", "代工", "foundry", "晶圆制造"],
    "封测": ["封测", "封装测试", "osat", "assembly and test"],
    "pcb": ["pcb", "印制电路板", "覆铜板", "ccl", "printed circuit board"],
    "连接器": ["连接器", "高速连接器", "connector", "高速铜连接"],
    "交换机": ["交换机", "网络交换机", "switch", "以太网交换机", "数据中心交换机"],
    "正极材料": ["正极材料", "正极", "cathode", "cathode material"],
    "负极材料": ["负极材料", "负极", "anode", "anode material"],
    "隔膜": ["隔膜", "separator", "锂电隔膜"],
    "电解液": ["电解液", "electrolyte", "电解质"],
    "固态电池": ["固态电池", "全固态电池", "半固态电池", "solid state battery"],
    "储能": ["储能", "储能系统", "energy storage", "ess", "bess"],
    "逆变器": ["逆变器", "inverter", "光伏逆变器"],
    "硅片": ["硅片", "wafer", "单晶硅片", "silicon wafer"],
    "谐波减速器": ["谐波减速器", "谐波减速机", "harmonic reducer", "减速器"],
    "丝杠": ["丝杠", "滚珠丝杠", "行星滚柱丝杠", "screw", "ball screw"],
    "灵巧手": ["灵巧手", "机械手", "dexterous hand", "末端执行器"],
    "cxo": ["cxo", "cro", "cdmo", "cmo", "医药外包"],
    "创新药": ["创新药", "innovative drug", "新药"],
    "adc": ["adc", "抗体偶联药物", "抗体药物偶联物", "antibody drug conjugate"],
    "大模型": ["大模型", "基础模型", "llm", "large language model", "foundation model"],
    "云计算": ["云计算", "算力租赁", "cloud", "idc", "云服务"],
    "供电": ["供电", "电源", "电源管理", "power supply", "供配电", "hvdc"],
}

# --- Fixed values: spelling repairs (lost "ff" ligature -> word) ------------------
LIGATURE_FIXES = {
    "eficiency": "efficiency", "eficiencies": "efficiencies", "eficient": "efficient",
    "eficiently": "efficiently", "diferentiation": "differentiation",
    "diferentiated": "differentiated", "diferent": "different", "diference": "difference",
    "diferences": "differences", "oferings": "offerings", "ofering": "offering",
    "ofer": "offer", "ofers": "offers", "ofered": "offered", "efect": "effect",
    "efects": "effects", "efective": "effective", "efectively": "effectively",
    "ofset": "offset", "ofsets": "offsets", "dificult": "difficult",
    "dificulty": "difficulty", "sufered": "suffered", "sufering": "suffering",
}

# --- Fixed values: promotional phrases and headings -------------------------------
PROMO_PHRASES = [
    "每日微信群内分享7+最新重磅报告；",
    "每日微信群内分享7+最新重磅报告;",
    "行研报告均为公开版，权利归原作者所有起点财经仅分发做内部学习。",
    "行研报告均为公开版，权利归原作者所有，起点财经仅分发做内部学习。",
    "扫一扫二维码关注公号回复:“研究报告”加入“起点财经”微信群",
    "起点财经，网罗天下报告",
]
COPYRIGHT_MARK = "行研报告均为公开版"
PROMO_LINE_PATTERNS = [
    r"#\s+(?:\*\*)?每日报告(?:\*\*)?\s*",
    r"##\s+(?:\*\*)?(?i:START\s*YOUR\s*FINANCE)(?:\*\*)?\s*",
    r"每日微信群内分享7\+最新重磅报告[；;]\s*",
    r"行研报告均为公开版，权利归原作者所有[，,]?起点财经仅分发做内部学习[。.]\s*",
    r"扫一扫二维码关注公号回复:“研究报告”加入“起点财经”微信群\s*",
    r"起点财经，网罗天下报告\s*",
]

# --- Fixed values: acquisition service states and codes ---------------------------
FAILED_STATES = ["failed", "error", "cancelled", "canceled"]
TERMINAL_STATES = ["done", "success", "failed", "error", "cancelled", "canceled"]
OK_CODES = ["0", "200"]
FATAL_CODES = ["A0202", "A0211", "A0212"]
DAILY_LIMIT_CODES = ["-60018"]
RETRYABLE_CODES = ["-60009", "-60007", "-10001"]
SUBMIT_BATCH_SIZE = 50
