"""Names, codes and rates that results depend on.

They are data, stated as they are; nothing here is computed.
"""

# --- fixed values: order status groups -------------------------------------
STATUS_GROUPS = {
    "Successful": ["充值成功"],
    "Refunded": ["已退款"],
    "Cancelled": ["已取消"],
    "Pending": ["等待支付", "待付款", "等待处理", "充值中"],
}

# --- fixed values: product category classes --------------------------------
CATEGORY_CLASSES = {
    "话费充值": ["充话费", "ENC", "PayGo", "Hotlink（Maxis）", "PIN码话费", "充值卡"],
    "电子钱包/PIN": ["Touch'n Go"],
    "电子钱包": ["电子钱包"],
    "流量套餐": ["买流量"],
    "账单缴费": ["交电费", "交水费", "污水处理", "固定电话", "电话缴费", "交话费",
             "电视缴费", "交网费", "宽带缴费", "生活缴费", "Sailk卡", "车辆罚款"],
    "后付费": ["后付费", "手机缴费"],
}
UNMAPPED_CLASS = "其他"
EWALLET_CLASSES = ("电子钱包/PIN", "电子钱包")

LABELS_EN = {
    "话费充值": "Airtime", "电子钱包/PIN": "E-wallet/PIN", "电子钱包": "E-wallet",
    "流量套餐": "Data", "账单缴费": "Bill Payment", "后付费": "Postpaid",
    "充话费": "Airtime top-up", "买流量": "Data bundle", "Touch'n Go": "Touch'n Go",
    "PIN码话费": "Airtime PIN", "充值卡": "Recharge card", "手机缴费": "Mobile bill",
    "交电费": "Electricity", "交水费": "Water", "污水处理": "Sewage", "固定电话": "Landline",
    "电视缴费": "TV", "宽带缴费": "Broadband", "交网费": "Internet", "Sailk卡": "Salik card",
    "车辆罚款": "Vehicle fines",
}

# --- fixed values: patterns ------------------------------------------------
DATA_CATEGORY_PATTERN = "(?i)data|流量|数据"
AIRTIME_CATEGORY_PATTERN = "(?i)充话费|后付费|PIN码|airtime|topup"
PRODUCT_SUFFIX_PATTERN = "(?i)(话费|流量|充值卡|缴费|数据|Data|Topup)"
UNLIMITED_PATTERN = "无限流量|不限量"

# --- fixed values: source heading -> canonical column ----------------------
CANONICAL_NAMES = {
    "国家": "country", "订单号": "order_id", "售价": "sales_listed", "实际支付": "sales_paid",
    "结算价": "settlement_price", "商品名称": "product", "商品信息": "product_info",
    "用户id": "user_id", "订单时间": "order_time", "注册时间": "register_time",
    "ip国家": "ip_country", "运营商": "operator", "商品分类": "product_category",
    "面额": "denomination", "代理商名称": "agent_name", "来源": "user_source",
    "ip地址": "ip_address", "订单状态": "order_status", "是否使用优惠券": "coupon_used",
    "批次号": "batch_number", "sku名称": "sku_name", "品牌商": "brand",
    "优惠券名称": "coupon_name", "优惠券金额": "coupon_amount", "是否新人优惠": "new_user_promo",
    "是否角标产品": "badge_product", "区号": "area_code", "充值号码": "recharge_number",
    "接口商订单号": "interface_order_id", "接口商名称": "supplier_name", "接口商id": "supplier_id",
    "用户来源": "user_channel", "支付方式": "payment_method", "支付机构": "payment_provider",
    "支付时间": "paid_time", "充值时间": "recharge_time", "服务费": "service_fee",
    "当地币币种": "local_currency", "分类": "product_category", "税费": "tax_fee",
    "序列号": "serial_number",
}
PASSTHROUGH_COLUMNS = (
    "date", "segment", "pin码", "用户名", "useepay订单号", "取消原因", "订单id", "unionid",
    "当地时间", "充值操作", "是否折扣金额", "支付订单号",
)

# --- fixed values: heading variants per stream -----------------------------
UPPERCASE_HEADINGS = {"IP地址": "ip地址", "IP国家": "ip国家", "SKU名称": "sku名称", "用户ID": "用户id"}
LOCAL_CURRENCY_HEADINGS = {
    "用户注册时间": "注册时间", "下单时间": "订单时间", "用户名称": "用户名",
    "用户ID": "用户id", "IP地址": "ip地址", "IP国家": "ip国家", "SKU名称": "sku名称",
    "售价(当地币)": "售价", "实际支付(当地币)": "实际支付", "服务费(当地币)": "服务费",
    "优惠金额(当地币)": "优惠券金额", "是否新人价": "是否新人优惠", "是否折扣价": "是否折扣金额",
    "支付订单号": "useepay订单号", "供应商订单号": "接口商订单号", "订单来源": "来源",
    "供应商ID": "供应商id",
}

# --- fixed values: column groups of the raw exports ------------------------
ID_COLUMNS = ("订单号", "接口商订单号", "充值号码", "useepay订单号", "订单ID", "unionid", "区号",
              "批次号", "供应商ID", "供应商订单号", "支付订单号", "PIN码", "pin码", "序列号", "接口商ID")
DATE_COLUMNS = ("订单时间", "注册时间")
NUMBER_COLUMNS = ("售价", "结算价", "实际支付", "面额", "优惠券金额", "税费", "服务费")
FILL_ZERO = ("优惠券金额", "税费", "服务费")
FILL_BLANK = ("优惠券名称", "取消原因", "用户名", "sku名称", "商品名称", "unionid", "接口商订单号",
              "useepay订单号", "充值号码", "pin码", "PIN码")
FILL_UNKNOWN = ("国家", "订单状态")

# --- fixed values: source folders and period names -------------------------
STREAM_FOLDERS = {"master": ("Master Data", "Master Data (RM)"), "agent": ("Agent Data",)}
PERIOD_NAMES = {"Master Data": ("Jul - Dec 2025", "2026"), "Agent Data": ("Whole",)}
HISTORY_PERIODS = ("Jul - Dec 2025",)

# --- fixed values: telephone calling code -> destination -------------------
CALLING_CODES = {
    1: "USA/Canada", 7: "Russia/Kazakhstan", 20: "Egypt", 27: "South Africa", 30: "Greece",
    31: "Netherlands", 33: "France", 34: "Spain", 39: "Italy", 40: "Romania",
    44: "United Kingdom", 49: "Germany", 51: "Peru", 52: "Mexico", 54: "Argentina",
    55: "Brazil", 56: "Chile", 57: "Colombia", 60: "Malaysia", 61: "Australia",
    62: "Indonesia", 63: "Philippines", 64: "New Zealand", 65: "Singapore", 66: "Thailand",
    81: "Japan", 82: "South Korea", 84: "Vietnam", 86: "China", 90: "Turkey", 91: "India",
    92: "Pakistan", 93: "Afghanistan", 94: "Sri Lanka", 95: "Myanmar", 98: "Iran",
    211: "South Sudan", 212: "Morocco", 213: "Algeria", 216: "Tunisia", 218: "Libya",
    220: "Gambia", 221: "Senegal", 223: "Mali", 225: "Côte d'Ivoire", 226: "Burkina Faso",
    227: "Niger", 228: "Togo", 229: "Benin", 230: "Mauritius", 231: "Liberia",
    232: "Sierra Leone", 233: "Ghana", 234: "Nigeria", 235: "Chad", 237: "Cameroon",
    241: "Gabon", 243: "DR Congo", 244: "Angola", 249: "Sudan", 250: "Rwanda",
    251: "Ethiopia", 252: "Somalia", 254: "Kenya", 255: "Tanzania", 256: "Uganda",
    260: "Zambia", 263: "Zimbabwe", 351: "Portugal", 352: "Luxembourg", 355: "Albania",
    380: "Ukraine", 420: "Czechia", 593: "Ecuador", 595: "Paraguay",
    675: "Papua New Guinea", 676: "Tonga", 679: "Fiji", 689: "French Polynesia",
    852: "Hong Kong", 853: "Macao", 855: "Cambodia", 856: "Laos", 880: "Bangladesh",
    886: "Taiwan", 960: "Maldives", 961: "Lebanon", 962: "Jordan", 963: "Syria",
    964: "Iraq", 965: "Kuwait", 966: "Saudi Arabia", 967: "Yemen", 968: "Oman",
    970: "Palestine", 971: "United Arab Emirates", 972: "Israel", 973: "Bahrain",
    974: "Qatar", 975: "Bhutan", 976: "Mongolia", 977: "Nepal", 992: "Tajikistan",
    993: "Turkmenistan", 994: "Azerbaijan", 995: "Georgia", 996: "Kyrgyzstan",
    998: "Uzbekistan",
}

# Destination labels that cover a market under another name.
DESTINATION_ALIASES = {
    "United States": "USA/Canada", "Canada": "USA/Canada",
    "Russia": "Russia/Kazakhstan", "Kazakhstan": "Russia/Kazakhstan",
    "Democratic Republic of the Congo": "DR Congo",
}

# --- fixed values: region -> markets ---------------------------------------
REGION_ORDER = ("Asia", "Middle East", "Africa", "Europe", "Americas", "Oceania", "Other")
REGION_MARKETS = {
    "Asia": [
        "China", "Hong Kong", "Macao", "Taiwan", "Japan", "South Korea", "North Korea", "Mongolia", "Malaysia",
        "Indonesia", "Singapore", "Thailand", "Vietnam", "Philippines", "Cambodia", "Laos", "Myanmar", "Brunei",
        "Timor-Leste", "India", "Pakistan", "Bangladesh", "Sri Lanka", "Nepal", "Bhutan", "Maldives", "Afghanistan",
        "Kazakhstan", "Uzbekistan", "Tajikistan", "Kyrgyzstan", "Turkmenistan",
    ],
    "Middle East": [
        "Saudi Arabia", "United Arab Emirates", "Qatar", "Kuwait", "Bahrain", "Oman", "Yemen", "Iran", "Iraq",
        "Syria", "Jordan", "Lebanon", "Israel", "Palestine", "Turkey", "Cyprus",
    ],
    "Africa": [
        "Egypt", "Libya", "Sudan", "South Sudan", "Morocco", "Algeria", "Tunisia", "South Africa", "Nigeria", "Kenya",
        "Ethiopia", "Tanzania", "Uganda", "Ghana", "Senegal", "Côte d'Ivoire", "Cameroon", "Zimbabwe", "Zambia",
        "Botswana", "Mozambique", "Angola", "Rwanda", "Burundi", "Somalia", "Djibouti", "Eritrea", "Madagascar",
        "Mauritius", "Seychelles", "Comoros", "Gambia", "Guinea", "Guinea-Bissau", "Sierra Leone", "Liberia", "Mali",
        "Burkina Faso", "Niger", "Chad", "Central African Republic", "Republic of the Congo",
        "Democratic Republic of the Congo", "Gabon", "Equatorial Guinea", "São Tomé and Príncipe", "Lesotho",
        "Eswatini", "Namibia", "Mauritania", "Benin", "Togo", "Cape Verde", "Malawi", "Réunion",
    ],
    "Europe": [
        "United Kingdom", "France", "Germany", "Italy", "Spain", "Portugal", "Netherlands", "Belgium", "Luxembourg",
        "Switzerland", "Austria", "Denmark", "Sweden", "Norway", "Finland", "Iceland", "Ireland", "Poland", "Czechia",
        "Slovakia", "Hungary", "Romania", "Bulgaria", "Greece", "Serbia", "Croatia", "Slovenia",
        "Bosnia and Herzegovina", "Montenegro", "North Macedonia", "Albania", "Russia", "Ukraine", "Belarus",
        "Moldova", "Lithuania", "Latvia", "Estonia", "Georgia", "Armenia", "Azerbaijan", "Malta", "Monaco", "Andorra",
        "Liechtenstein", "San Marino", "Vatican City",
    ],
    "Americas": [
        "United States", "Canada", "Mexico", "Guatemala", "Belize", "Honduras", "El Salvador", "Nicaragua",
        "Costa Rica", "Panama", "Cuba", "Jamaica", "Haiti", "Dominican Republic", "Puerto Rico",
        "Trinidad and Tobago", "Barbados", "Bahamas", "Brazil", "Argentina", "Chile", "Peru", "Colombia", "Venezuela",
        "Ecuador", "Bolivia", "Paraguay", "Uruguay", "Suriname", "Guyana", "French Guiana", "Dominica", "Curaçao",
        "Grenada", "Bermuda", "Antigua and Barbuda",
    ],
    "Oceania": [
        "Australia", "New Zealand", "Papua New Guinea", "Fiji", "Tonga", "Samoa", "Vanuatu", "Solomon Islands",
        "Kiribati", "Tuvalu", "Nauru", "Palau", "Micronesia", "Marshall Islands",
    ],
}

# --- fixed values: English market names that differ from the locale data ---
ENGLISH_BY_ISO2 = {
    "AG": "Antigua and Barbuda", "BA": "Bosnia and Herzegovina",
    "CD": "Democratic Republic of the Congo", "CG": "Republic of the Congo",
    "CI": "Côte d'Ivoire", "HK": "Hong Kong", "MM": "Myanmar", "MO": "Macao", "PS": "Palestine",
    "ST": "São Tomé and Príncipe", "TR": "Turkey", "TT": "Trinidad and Tobago",
}
# --- fixed values: Chinese names beside those of the locale data -----------
CHINESE_ALIASES = {
    "中国大陆": "China", "中国香港": "Hong Kong", "香港": "Hong Kong", "中国澳门": "Macao",
    "澳门": "Macao", "中国台湾": "Taiwan", "大韩民国": "South Korea", "南韩": "South Korea",
    "蒙古国": "Mongolia", "印度尼西亚(印尼)": "Indonesia", "印尼": "Indonesia",
    "孟加拉": "Bangladesh", "沙特": "Saudi Arabia", "阿联酋": "United Arab Emirates",
    "巴勒斯坦": "Palestine", "象牙海岸": "Côte d'Ivoire", "刚果共和国": "Republic of the Congo",
    "刚果(布)": "Republic of the Congo", "刚果民主共和国": "Democratic Republic of the Congo",
    "刚果(金)": "Democratic Republic of the Congo", "刚果金": "Democratic Republic of the Congo",
    "埃斯瓦蒂尼": "Eswatini", "波黑": "Bosnia and Herzegovina", "马其顿": "North Macedonia",
    "多米尼加": "Dominican Republic", "留尼旺": "Réunion", "澳洲": "Australia",
    "未知": "Unknown", "其他": "Other",
}

# --- fixed values: USD pegs (local per USD) --------------------------------
USD_PEGS = {
    "SAR": 3.75, "AED": 3.6725, "QAR": 3.64, "OMR": 0.3845, "JOD": 0.709, "BHD": 0.376,
    "PAB": 1.0, "BSD": 1.0, "BMD": 1.0, "XCD": 2.70, "BBD": 2.0, "BZD": 2.0, "CUP": 24.0,
    "DJF": 177.72, "ERN": 15.0, "LBP": 89500.0,
}

# --- fixed values: indicative rates, local currency per 1 RMB --------------
SNAPSHOT_AS_OF = "2025-06"
# country | symbol | currency | rate
SNAPSHOT_RATES = [
    ("China", "¥", "CNY", 1.0),
    ("Hong Kong", "HK$", "HKD", 1.09),
    ("Macao", "MOP", "MOP", 1.12),
    ("Taiwan", "NT$", "TWD", 4.5),
    ("Japan", "¥", "JPY", 21.0),
    ("South Korea", "₩", "KRW", 192.0),
    ("Mongolia", "₮", "MNT", 480.0),
    ("Malaysia", "RM", "MYR", 0.66),
    ("Indonesia", "Rp", "IDR", 2250.0),
    ("Singapore", "S$", "SGD", 0.19),
    ("Thailand", "฿", "THB", 5.0),
    ("Vietnam", "₫", "VND", 3500.0),
    ("Philippines", "₱", "PHP", 8.0),
    ("Cambodia", "៛", "KHR", 565.0),
    ("Laos", "₭", "LAK", 3030.0),
    ("Myanmar", "K", "MMK", 292.0),
    ("Brunei", "B$", "BND", 0.19),
    ("India", "₹", "INR", 11.7),
    ("Pakistan", "Rs", "PKR", 39.0),
    ("Bangladesh", "৳", "BDT", 17.0),
    ("Sri Lanka", "Rs", "LKR", 42.0),
    ("Nepal", "Rs", "NPR", 19.0),
    ("Bhutan", "Nu", "BTN", 11.7),
    ("Maldives", "Rf", "MVR", 2.16),
    ("Afghanistan", "؋", "AFN", 10.0),
    ("Kazakhstan", "₸", "KZT", 70.0),
    ("Uzbekistan", "сўм", "UZS", 1800.0),
    ("Tajikistan", "SM", "TJS", 1.5),
    ("Kyrgyzstan", "сом", "KGS", 12.2),
    ("Turkmenistan", "m", "TMT", 0.49),
    ("Saudi Arabia", "﷼", "SAR", 0.52),
    ("United Arab Emirates", "د.إ", "AED", 0.51),
    ("Qatar", "﷼", "QAR", 0.51),
    ("Kuwait", "د.ك", "KWD", 0.043),
    ("Bahrain", "د.ب", "BHD", 0.052),
    ("Oman", "﷼", "OMR", 0.054),
    ("Yemen", "﷼", "YER", 35.0),
    ("Iran", "﷼", "IRR", 5850.0),
    ("Iraq", "د.ع", "IQD", 184.0),
    ("Syria", "£", "SYP", 1800.0),
    ("Jordan", "د.أ", "JOD", 0.099),
    ("Lebanon", "ل.ل", "LBP", 12500.0),
    ("Israel", "₪", "ILS", 0.51),
    ("Palestine", "₪", "ILS", 0.51),
    ("Turkey", "₺", "TRY", 5.4),
    ("Cyprus", "€", "EUR", 0.13),
    ("Egypt", "ج.م", "EGP", 7.1),
    ("Libya", "ل.د", "LYD", 0.68),
    ("Sudan", "ج.س", "SDG", 84.0),
    ("South Sudan", "£", "SSP", 280.0),
    ("Morocco", "د.م", "MAD", 1.4),
    ("Algeria", "د.ج", "DZD", 19.0),
    ("Tunisia", "د.ت", "TND", 0.44),
    ("South Africa", "R", "ZAR", 2.6),
    ("Nigeria", "₦", "NGN", 225.0),
    ("Kenya", "KSh", "KES", 18.0),
    ("Ethiopia", "Br", "ETB", 18.0),
    ("Tanzania", "TSh", "TZS", 380.0),
    ("Uganda", "USh", "UGX", 525.0),
    ("Ghana", "GH₵", "GHS", 2.2),
    ("Senegal", "CFA", "XOF", 86.0),
    ("Côte d'Ivoire", "CFA", "XOF", 86.0),
    ("Cameroon", "FCFA", "XAF", 86.0),
    ("Zimbabwe", "$", "USD", 0.14),
    ("Zambia", "K", "ZMW", 3.8),
    ("Botswana", "P", "BWP", 1.9),
    ("Mozambique", "MT", "MZN", 8.9),
    ("Angola", "Kz", "AOA", 128.0),
    ("Rwanda", "RF", "RWF", 185.0),
    ("Burundi", "FBu", "BIF", 400.0),
    ("Madagascar", "Ar", "MGA", 640.0),
    ("Mauritius", "Rs", "MUR", 6.4),
    ("Mali", "CFA", "XOF", 86.0),
    ("Burkina Faso", "CFA", "XOF", 86.0),
    ("Niger", "CFA", "XOF", 86.0),
    ("Chad", "FCFA", "XAF", 86.0),
    ("Benin", "CFA", "XOF", 86.0),
    ("Togo", "CFA", "XOF", 86.0),
    ("Guinea", "FG", "GNF", 1200.0),
    ("Sierra Leone", "Le", "SLL", 3100.0),
    ("Liberia", "L$", "LRD", 26.0),
    ("Eswatini", "L", "SZL", 2.6),
    ("Namibia", "N$", "NAD", 2.6),
    ("Mauritania", "UM", "MRU", 5.5),
    ("Malawi", "MK", "MWK", 240.0),
    ("Réunion", "€", "EUR", 0.13),
    ("United Kingdom", "£", "GBP", 0.11),
    ("France", "€", "EUR", 0.13),
    ("Germany", "€", "EUR", 0.13),
    ("Italy", "€", "EUR", 0.13),
    ("Spain", "€", "EUR", 0.13),
    ("Portugal", "€", "EUR", 0.13),
    ("Netherlands", "€", "EUR", 0.13),
    ("Belgium", "€", "EUR", 0.13),
    ("Luxembourg", "€", "EUR", 0.13),
    ("Austria", "€", "EUR", 0.13),
    ("Ireland", "€", "EUR", 0.13),
    ("Greece", "€", "EUR", 0.13),
    ("Finland", "€", "EUR", 0.13),
    ("Estonia", "€", "EUR", 0.13),
    ("Latvia", "€", "EUR", 0.13),
    ("Lithuania", "€", "EUR", 0.13),
    ("Slovenia", "€", "EUR", 0.13),
    ("Slovakia", "€", "EUR", 0.13),
    ("Croatia", "€", "EUR", 0.13),
    ("Malta", "€", "EUR", 0.13),
    ("Monaco", "€", "EUR", 0.13),
    ("Andorra", "€", "EUR", 0.13),
    ("San Marino", "€", "EUR", 0.13),
    ("Vatican City", "€", "EUR", 0.13),
    ("Switzerland", "CHF", "CHF", 0.12),
    ("Denmark", "kr", "DKK", 0.97),
    ("Sweden", "kr", "SEK", 1.5),
    ("Norway", "kr", "NOK", 1.5),
    ("Iceland", "kr", "ISK", 19.0),
    ("Poland", "zł", "PLN", 0.56),
    ("Czechia", "Kč", "CZK", 3.2),
    ("Hungary", "Ft", "HUF", 50.0),
    ("Romania", "lei", "RON", 0.64),
    ("Bulgaria", "лв", "BGN", 0.25),
    ("Serbia", "дин", "RSD", 15.0),
    ("Bosnia and Herzegovina", "KM", "BAM", 0.25),
    ("Montenegro", "€", "EUR", 0.13),
    ("North Macedonia", "ден", "MKD", 7.9),
    ("Albania", "L", "ALL", 13.0),
    ("Russia", "₽", "RUB", 12.5),
    ("Ukraine", "₴", "UAH", 5.8),
    ("Belarus", "Br", "BYN", 0.46),
    ("Moldova", "L", "MDL", 2.5),
    ("Georgia", "₾", "GEL", 0.39),
    ("Armenia", "֏", "AMD", 55.0),
    ("Azerbaijan", "₼", "AZN", 0.24),
    ("United States", "$", "USD", 0.14),
    ("Canada", "C$", "CAD", 0.19),
    ("Mexico", "MX$", "MXN", 2.55),
    ("Guatemala", "Q", "GTQ", 1.07),
    ("Honduras", "L", "HNL", 3.45),
    ("El Salvador", "$", "USD", 0.14),
    ("Nicaragua", "C$", "NIO", 5.0),
    ("Costa Rica", "₡", "CRC", 72.0),
    ("Panama", "$", "PAB", 0.14),
    ("Cuba", "$MN", "CUP", 3.4),
    ("Jamaica", "J$", "JMD", 21.0),
    ("Haiti", "G", "HTG", 18.0),
    ("Dominican Republic", "RD$", "DOP", 8.0),
    ("Puerto Rico", "$", "USD", 0.14),
    ("Trinidad and Tobago", "TT$", "TTD", 0.93),
    ("Barbados", "Bds$", "BBD", 0.28),
    ("Bahamas", "B$", "BSD", 0.14),
    ("Brazil", "R$", "BRL", 0.81),
    ("Argentina", "$", "ARS", 130.0),
    ("Chile", "CLP", "CLP", 130.0),
    ("Peru", "S/", "PEN", 0.52),
    ("Colombia", "COL$", "COP", 580.0),
    ("Venezuela", "Bs", "VES", 5.1),
    ("Ecuador", "$", "USD", 0.14),
    ("Bolivia", "Bs", "BOB", 0.96),
    ("Paraguay", "₲", "PYG", 1050.0),
    ("Uruguay", "$U", "UYU", 5.6),
    ("Belize", "BZ$", "BZD", 0.28),
    ("Suriname", "Sr$", "SRD", 5.3),
    ("Guyana", "G$", "GYD", 29.0),
    ("French Guiana", "€", "EUR", 0.13),
    ("Dominica", "EC$", "XCD", 0.38),
    ("Curaçao", "ƒ", "ANG", 0.25),
    ("Grenada", "EC$", "XCD", 0.38),
    ("Bermuda", "BD$", "BMD", 0.14),
    ("Antigua and Barbuda", "EC$", "XCD", 0.38),
    ("Australia", "A$", "AUD", 0.21),
    ("New Zealand", "NZ$", "NZD", 0.23),
    ("Papua New Guinea", "K", "PGK", 0.55),
    ("Fiji", "FJ$", "FJD", 0.31),
]
