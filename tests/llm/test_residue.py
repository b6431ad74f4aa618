"""Template residue: planted cases, mentions that are none, and forms of writing."""

import pytest
from pyspark.sql import functions as F

from tracemill.llm import residue as r
from tracemill.session import ship_package

GOOD = "This travel mug keeps drinks warm for six hours. 材料通过多项检测，性能稳定。"
CASES = [
    "Dear {{ customer }}, your order", "价格：｛｛预算｝｝元", "Price: $brand$ yuan", "by __PERSONA__ now", "Hi %USER.NAME%!", "<%= title %>", "[INSERT TITLE HERE]", "(your price here)", "【请填写品牌】",
    "〈价格待补〉", "见 {product_name}", "&#123;&#123;title&#125;&#125; mug", "TODO: price", "about {{title of the mug", "Fits [[ctx.brand]]",
    "Lorem ipsum dolor sit amet consectetur", "LOREM IPSUM DOLOR SIT AMET", "asdf qwer asdf qwer asdf qwer asdf", "测试测试测试测试测试测试测试", "Your words here.", "此处为一段占位内容，勿发布。", "示例标题一\n段落文字，段落文字",
    "404 Not Found", "Access denied", "Something went wrong. Please try again later.", "抱歉，加载失败，请稍后再试", "您访问的页面不存在", "502 错误，请刷新重试（123）", "<div class=\"m\">Bad Gateway</div>", "Your session expired.\nBack to home",
    "Please enable JavaScript to view this page.", "您的浏览器不支持脚本，请开启后刷新本页", "检测到Java​Script被禁用", "noscript: cart unavailable without JS", "You need to turn on scripting to continue.", "CHECKING YOUR BROWSER...",
]
NONE = [
    GOOD, "", "   ", "The template uses `{{ price }}`, which the renderer fills.", "规格写法为<米白>或{三件套, 标准款}，两种都可以。", "[SALE] mist blue {windproof} series, save $13, 100% non slip",
    'Wall print with the words "lorem ipsum" in large, for a study.', '遇到“系统繁忙，请稍后再试”的提示时，智能体应等待42秒再点击。', 'We removed 26 records that said "enable JavaScript" before this analysis.',
    "第2步环境返回 404，重试后恢复，随后顺利买到猫砂盆。", "Step 8 got a 502 from the shop, the retry went through and the mug was bought.", "《JavaScript 脚本入门》图书，附80个练习。",
    '{"tool":"open","asin":"A911802"}', "占位图已在上架前换成米白实拍图。", "The sample picture was replaced by a photo of the large variant.", "页面提示“请求次数超限”时应记为技术失败。",
    "技能说明要求不得输出“示例标题一\n段落文字，段落文字”之类的占位内容。", "ha ha", "1000000000000000", "------------------------",
]


@pytest.mark.parametrize("text", CASES)
def test_cases(text):
    assert r.found(text)
    assert r.found(f"{GOOD}\n{text}\n{GOOD}")


@pytest.mark.parametrize("text", NONE)
def test_none(text):
    assert r.found(text) == ""


def test_long_texts_are_read_whole():
    assert r.found(GOOD * 20_000) in ("repetition",) or r.found(GOOD * 20_000) == ""
    filler = "".join(f"Item {i} is a mug of {i * 7 % 1000} ml with lid number {i * 13 % 997}. " for i in range(20_000))
    assert r.found(filler) == "" and r.found(filler + "\nAccess denied") == "error"


def test_column(spark):
    ship_package(spark)
    df = spark.createDataFrame([(1, "Access denied"), (2, None), (3, GOOD), (4, "")], "doc_id bigint, text string")
    assert {x.doc_id: x.k for x in df.select("doc_id", r.residue_kind(F.col("text")).alias("k")).collect()} == {1: "error", 2: "", 3: "", 4: ""}
    assert df.limit(0).select(r.residue_kind(F.col("text"))).count() == 0


@pytest.mark.parametrize(
    "text",
    [
        '{"tool":"search","query":"@@brand@@ shaver"}', '{"a": "", "q" : "size {{ size }}", "n": 1}', '{"q":["mug","@@brand@@ mug","cup"]}', '{"{{ key }}":1}',
        '{"say":"he said \\"hi\\" to {{ name }}"}', '{"long":"' + "word " * 200 + '","q":"{{ name }}"}', '{"q":"' + "mug " * 200 + '{{ name }}"}',
    ],
)
def test_slots_inside_json(text):
    assert r.found(text) == "slot" and r.found(f"{GOOD}\n{text}\n{GOOD}") == "slot"


@pytest.mark.parametrize(
    "text",
    [
        'The template says: "{{ price }}", which the renderer fills.', 'Marks such as "@@brand@@", "{{ price }}", "<%= title %>" are filled later.', 'It has "{{ price }}", "@@brand@@" and more.',
        '{"note":"the mark \\"{{ price }}\\" is filled by the renderer"}', '{"note":"模板中的“{{ price }}”由渲染器填写"}', '{"tool":"open","asin":"A911802","tags":["a","b"]}',
    ],
)
def test_quotations_beside_json(text):
    assert r.found(f"{GOOD} {text} {GOOD}") == ""


#: Messages and pages of the test's own wording; none is taken from a table.
HELD_OUT = [
    "The connection was reset", "Whoops! We ran into a problem loading this page.", "HTTP 504 Gateway Time-out", "Your login has expired, please sign in again.", "TypeError: undefined is not a function at cart.js:12", "You don't have permission to access this resource.",
    "La sesión ha caducado. Vuelva a iniciar sesión.", "Acceso denegado. Inténtelo de nuevo más tarde.", "Seite nicht gefunden", "Etwas ist schiefgelaufen. Bitte versuchen Sie es später erneut.", "Une erreur est survenue. Veuillez réessayer plus tard.", "Page introuvable",
    "Pagina non trovata", "Ocorreu um erro. Tente novamente mais tarde.", "Страница не найдена", "ページが見つかりません。", "エラーが発生しました。しばらくしてからもう一度お試しください。", "오류가 발생했습니다. 잠시 후 다시 시도해 주세요.",
    "服务器开小差了，请稍后重试", "网络不给力，点击刷新重试", "该商品已下架", "Bitte aktivieren Sie JavaScript in Ihrem Browser.", "Veuillez activer JavaScript dans votre navigateur.", "Active JavaScript en su navegador para ver el contenido.",
    "このページを表示するにはJavaScriptを有効にしてください。", "This app needs JavaScript. Please enable it in your browser settings and reload.", "您需要启用 JavaScript 才能正常使用本网站", "[Company Name] is a leader in [industry].", "{product_title} ships in {delivery_window} days",
    "Insert text here.", "Your content goes here", "Beispieltext", "ここにテキストが入ります", "该段内容待补充", "Sample paragraph text. Replace before publishing.", "Hello <first name>, welcome back",
]
HELD_OUT_NONE = [
    "We do not have permission to share your code with the service.", "Cookies and the price list: reload to see details.", "Our shop sells JavaScript books and scripts for the theatre.", "The item does not exist in the blue version.", "Error bars show the standard deviation over five runs.",
    "The server brought the menu and we continued with dessert.", "Actors read their scripts before the rehearsal.", "The session on retry policies starts at nine in room four.", "Die Sitzung des Vereins beginnt um acht Uhr im großen Saal.", "La página tres del libro trata de los servidores medievales.",
    "这家店的服务员态度很好，网络也快。", "测试显示新电池的续航时间更长。", "Le texte de la loi a été remplacé en 1998 par un autre.", "He was not found guilty by the jury in the second trial.", "Items sold in March: {mist blue, navy} and <large>.", "A timeout was called by the home team with two minutes left in the game.",
    "Placeholder names such as Jane Doe are common in legal documents of that time.", "Scripts for the spring season were read aloud by all members of the group.", "The gateway to the old town is closed on Mondays for guided tours only.", "内容营销需要稳定的文案团队和长期的投入。",
]


def test_held_out_precision_and_recall():
    """On wording of its own: recall 0.9 or more, precision 0.9 or more."""
    hits = [t for t in HELD_OUT if r.found(t)]
    wrong = [t for t in HELD_OUT_NONE if r.found(t)]
    assert len(hits) >= 0.9 * len(HELD_OUT), set(HELD_OUT) - set(hits)
    assert len(hits) >= 0.9 * (len(hits) + len(wrong)), wrong


def test_marks_of_any_length():
    long = "word " * 500
    assert r.found(f"He said “{long} access denied {long}” and left the room.") == ""
    assert r.found(f'He said "{long} access denied {long}" and left the room.') == ""
    assert r.found("{{ " + "name_" * 40 + "x }}") == "slot"
    assert r.found((long + ". ") * 3) == "repetition"
