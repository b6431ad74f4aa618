"""Template residue, filler text, error pages and script notices.

Method: a multi-pattern automaton looks for the set phrases of error pages, filler and
script notices in ten languages. The passage (sentence) around each hit is measured: the
share of its letters that phrases and the usual words of such messages cover. Words that
carry no content (articles, pronouns, particles) count on neither side, so they neither
make a message nor hide one. At ``COVERAGE`` or more the passage *is* such a message; below
it only speaks of one. A passage is measured against its own length, since residue inside a
good document is a case as well. A document is excluded if any of its passages is residue,
or if it has an unfilled slot such as ``{{ price }}``, or a unit repeated over and over.

Spans in quotation marks, back quotes and book-title marks are quotations: they are
taken out before anything is matched, and a sentence with one is no message itself.
Keys and values of JSON are none: slots are looked for inside them too.

The phrases are the wording of common servers, browsers, shops and templates. They are not
fitted to one corpus; ``tests/llm/test_residue.py`` measures them on messages of its own.

Defined results: null and empty texts are no cases. Whole texts are read, however
long; matching is linear in the text.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Share of a passage's content letters that must be covered.
COVERAGE = 0.6

# Set phrases by kind. A phrase opens the examination of its passage.
PHRASES = {
    "error": """
access denied|access is denied|access forbidden|permission denied|request blocked|request denied|request has been blocked|something went wrong|unexpected error|unknown error|oops|whoops|hit a snag|ran into a problem|bad gateway|internal server error|internal error
service unavailable|service is unavailable|service temporarily unavailable|temporarily unavailable|not found|page not found|403 forbidden|too many requests|gateway timeout|gateway time-out|request timeout|request timed out|connection timed out|operation timed out
timed out|session expired|session has expired|session has ended|session ended|sign-in has ended|sign-in has expired|login has expired|token expired|token has expired|rate limit|rate limit reached|rate limit exceeded|401 unauthorized|bad request|try again later|slow down and retry|that did not work
cannot be displayed|could not be loaded|cannot be loaded|failed to load|could not load|cannot load|could not render|under maintenance|down for maintenance|back to home|page has moved|no longer available|no longer exists|does not exist|has been removed|was removed|may have been removed|moved or removed
you do not have permission|you don't have permission|you are not authorized|you are not allowed|not authorized to view|not authorized to access|you are looking for|could not be found|cannot be found|can't be found|connection was reset|connection reset|connection refused|closed the connection|server closed the connection|host unreachable
fatal:|error:|panic:|exception:|unhandled exception|uncaught exception|traceback (most recent call last)|null pointer|is not a function|is not an object|is not defined|cannot read propert|segmentation fault|stack overflow|out of memory|error code|error occurred|error has occurred|an error occurred|database is not available|system error|service is down
404 not found|403 错误|404 错误|500 错误|502 错误|503 错误|504 错误|被拒绝|被拦截|服务拥挤|请求失败|请求错误|请求超时|请求被拒绝|请求被拦截|服务器错误|服务器内部错误|服务器繁忙|服务器开小差|系统繁忙|系统错误|系统异常|系统维护|系统开小差|系统超时|系统拥挤|系统出错|服务异常|服务不可用|服务超时|服务繁忙|服务错误|暂时不可用|网络异常|网络错误|网络超时|网络繁忙|网络拥挤|网络开小差|网络不给力|开小差
网关异常|网关错误|网关超时|连接超时|连接失败|连接已断开|加载失败|加载超时|加载出错|操作失败|操作超时|操作过于频繁|访问过于频繁|请求过于频繁|点击过于频繁|过于频繁|次数超限|次数过多|已达上限|访问被拒绝|访问受限|拒绝访问|无权访问|禁止访问|没有访问权限|没有权限|权限不足|未授权|无法访问|无法显示该|无法完成您的请求|无法打开该
页面不存在|页面未找到|未找到|找不到页面|找不到您|您访问的|您要找的|您查找的|页面走丢|页面丢失|走丢了|已下架|已被移除|已被删除|已失效|已过期|已超时|会话超时|会话已|登录已|登录状态已|凭证已|令牌已|请重新登录|稍后再试|稍后重试|刷新重试|完成验证后继续|正在维护|维护中|错误码|出错了|出现错误|发生错误|未知错误
acceso denegado|página no encontrada|no se encontró la página|error interno del servidor|algo salió mal|se ha producido un error|servicio no disponible|inténtelo de nuevo más tarde|inténtalo de nuevo más tarde|sesión ha caducado|sesión ha expirado|demasiadas solicitudes|tiempo de espera agotado|no se pudo cargar|no tiene permiso
zugriff verweigert|seite nicht gefunden|seite wurde nicht gefunden|interner serverfehler|etwas ist schiefgelaufen|etwas ist schief gelaufen|ist ein fehler aufgetreten|fehler ist aufgetreten|dienst nicht verfügbar|versuchen sie es später erneut|sitzung ist abgelaufen|zu viele anfragen|zeitüberschreitung|konnte nicht geladen werden|keine berechtigung
accès refusé|accès interdit|page introuvable|page non trouvée|erreur interne du serveur|une erreur est survenue|une erreur s'est produite|un problème est survenu|service indisponible|service temporairement indisponible|veuillez réessayer plus tard|session a expiré|session est expirée|trop de requêtes|délai d'attente dépassé|n'a pas pu être chargé|n'avez pas l'autorisation
acesso negado|página não encontrada|erro interno do servidor|algo deu errado|ocorreu um erro|serviço indisponível|tente novamente mais tarde|sessão expirou|muitas solicitações|não foi possível carregar|accesso negato|pagina non trovata|errore interno del server|qualcosa è andato storto|si è verificato un errore|servizio non disponibile|riprova più tardi|sessione è scaduta|troppe richieste
доступ запрещен|доступ запрещён|страница не найдена|внутренняя ошибка сервера|что-то пошло не так|произошла ошибка|сервис недоступен|повторите попытку позже|попробуйте позже|сеанс истек|сессия истекла|слишком много запросов|не удалось загрузить
ページが見つかりません|アクセスが拒否|アクセスできません|エラーが発生しました|サーバーエラー|内部エラー|サービスは利用できません|しばらくしてから|もう一度お試し|再度お試し|セッションの有効期限|セッションが切れ|タイムアウトしました|読み込めませんでした|メンテナンス中|権限がありません
페이지를 찾을 수 없|접근이 거부|액세스가 거부|오류가 발생|서버 오류|서비스를 사용할 수 없|잠시 후 다시|다시 시도해|세션이 만료|요청이 너무 많|불러올 수 없|점검 중
""",
    "script": """
javascript|java script|scripting|scripts|noscript|enable scripts|allow scripts|turn on scripts|run scripts|without scripts|scripts are|scripts must|scripts to|scripts and cookies|page scripts|js|enable cookies|allow cookies|cookies are disabled|cookies must|checking your browser|checking if the site connection is secure|unsupported browser|browser is not supported|browser is out of date
脚本|浏览器环境|检查您的浏览器|浏览器不支持|浏览器版本过低|启用cookie|开启cookie|ジャバスクリプト|スクリプト|자바스크립트|스크립트|сценарии|скрипты
""",
    "filler": """
lorem ipsum|dolor sit amet|your words here|your text here|your content here|text goes here|content goes here|copy goes here|title goes here|description goes here|goes here|for layout only|replace before publishing|before publishing|before going live|sample text|example text|dummy text|placeholder text|filler text|sample paragraph|example paragraph|dummy paragraph|placeholder paragraph|filler paragraph
paragraph text|sample copy|example copy|dummy copy|placeholder copy|filler copy|body copy|body text|copy to come|text to come|delete this line|remove this line|delete this text|replace this text|insert text here|add text here|enter text here|type here|content here|text here|to be written|to be added|to be completed|to be filled in|heading one|heading two|placeholder
占位|占个位|示例文字|示例段落|示例文案|示例内容|示例标题|示例文本|样例文字|测试文案|测试文字|测试内容|测试段落|测试数据请忽略|默认文案|默认文字|模板文字|段落文字|段落文本|正文正文|内容待补充|待补充|待完善|待填写|待编辑|待添加|内容待定|暂缺|暂无内容|代替|稍后填写|稍后补充|稍后补上|后续补充|后续补上|勿发布|请勿发布|上线前删除|上线前替换|发布前删除|发布前替换|敬请期待|在此输入|此处输入|此处填写|此处放|这里放
texto de ejemplo|texto de relleno|texto de prueba|escriba aquí su texto|beispieltext|blindtext|platzhaltertext|platzhalter|mustertext|texte d'exemple|texte de remplissage|faux texte|votre texte ici|texto de exemplo|testo di esempio|testo segnaposto|текст-заполнитель|пример текста|サンプルテキスト|ダミーテキスト|ここにテキスト|テキストが入ります|예시 텍스트|여기에 텍스트
""",
}
# Content words that such messages usually have beside their phrase. They cover, but open nothing.
WORDS = {
    "error": """
page pages site website url link links request requests session server servers service services system network connection gateway proxy upstream host database login sign-in sign signed log token resource content item product listing store shop account application app view access denied forbidden blocked refused reset closed expired ended
timed timeout unavailable unauthorized invalid unexpected unknown internal bad wrong failed failure fail error errors code status reference id exception null undefined object handler module line function stack trace fatal render load loading loaded display displayed found exist exists available moved removed deleted maintenance temporarily down busy
overloaded limit reached exceeded rate too many times slow wait seconds second minutes minute moment shortly try again later retry refresh reload reloading back home homepage return continue contact support administrator admin help sorry apologies apologize inconvenience oops please check address
页面 网页 内容 网站 链接 请求 会话 服务器 服务 系统 网络 连接 网关 内部 接口 数据库 登录 重新登录 凭证 令牌 状态 权限 访问 点击 操作 次数 编号 代码 错误 异常 失败 超时 超限 过期 失效 繁忙 拥挤 频繁 拒绝 拦截 禁止 限制 下架 移除 删除 不存在 找不到 要找 无法 完成 验证 继续 刷新 重试 再试 稍后 稍候 稍等 片刻 等待 秒后 秒 分钟 返回 首页 上一页 加载 显示 维护 关闭 不可用 联系 客服 管理员 支持 提示 抱歉 疑问 自动跳转 跳转 查看 商品 店铺 开小差 走丢
página sitio servidor servicio sesión solicitud error navegador contenido enlace soporte cargar actualice recargue vuelva intente inicio seite server dienst sitzung anfrage fehler browser inhalt verbindung support laden aktualisieren versuchen später erneut startseite page site serveur service session requête erreur contenu lien connexion actualisez rechargez réessayez accueil
página servidor serviço sessão solicitação erro conteúdo tente novamente pagina server servizio sessione richiesta errore contenuto riprova страница сайт сервер сервис сеанс запрос ошибка попробуйте обновите позже ページ サイト サーバー サービス セッション エラー 再読み込み 時間 後で 페이지 사이트 서버 서비스 오류 새로고침 나중에
""",
    "script": """
browser browsers javascript script scripts scripting js cookies cookie client-side enable enabled enabling disable disabled activate activated allow allowed turn turned switch switched off block blocked blocks required require requires requiring need needs needed must support supports supported unsupported rely relies depend depends run runs running work works working properly correctly
page site website app application shop store content view display displayed show shown load loaded loading reload refresh continue proceed browse settings version update upgrade checking secure connection moment please detected unavailable full features functionality variants reviews prices price list details product products cart checkout see use go
脚本 浏览器 页面 网页 本页 本页面 本站 本店 网站 内容 完整 列表 商品 价格 评论 评价 规格 详情 购物车 功能 环境 安全 检测 检查 正在 启用 未启用 开启 未开启 打开 允许 禁用 屏蔽 拦截 关闭 支持 不支持 依赖 需要 必须 更换 升级 设置 刷新 加载 显示 查看 浏览 继续 运行 访问 跳转 无法 部分 正常 使用 才能 秒后 重试 cookie javascript js
navegador active activar activado habilite habilitar desactivado página sitio contenido necesita requiere funcionar ver aktivieren aktiviert deaktiviert seite benötigt browser inhalt anzeigen erforderlich navigateur activer activez activé désactivé page nécessite contenu afficher fonctionner nécessaire ative ativar desativado navegador requer conteúdo attiva attivare disattivato richiede contenuto браузер браузере включите включить отключен страница требуется содержимое
ブラウザ 有効 無効 ページ 表示 必要 設定 してください 브라우저 활성화 비활성화 페이지 표시 필요 설정
""",
    "filler": """
text paragraph copy words title heading headline subtitle body content layout sample example dummy placeholder filler template default replace delete remove insert write add enter type publish publishing published launch live come coming soon here line section description one two three only note draft page used
内容 文字 文案 文本 段落 正文 标题 副标题 说明 介绍 公告 规格 商品 店铺 页面 技能 任务 模板 默认 示例 样例 测试 占位 位置 排版 使用 仅供 填写 填入 补充 补上 添加 替换 删除 发布 上线 稍后 后续 此处 这里 本段 一段 暂无 待定 放置
lorem ipsum dolor sit amet consectetur adipiscing elit sed eiusmod tempor incididunt labore dolore magna aliqua enim minim veniam quis nostrud exercitation ullamco laboris nisi aliquip commodo consequat duis aute irure reprehenderit voluptate velit esse cillum fugiat nulla pariatur excepteur sint occaecat cupidatat proident sunt culpa officia deserunt mollit anim laborum
texto ejemplo relleno prueba reemplazar publicar ersetzen löschen veröffentlichen text texte exemple remplacer supprimer publier texto substituir testo sostituire текст заменить テキスト サンプル ダミー 텍스트 예시
""",
}
# Words without content of their own.
STOP = """
a an the this that these those it its i we you he she they our your their my us me them is are was were be been being am do does did has have had will would can could should may might to of in on at by for from with without and or but if as so than then there here not no yes before after when while which who what how all any some just also very more most please again on up out
el la los las un una unos unas de del en y o a al su sus se ha han que por para con sin no lo le es está este esta más favor der die das den dem des ein eine einen ist sind war wurde wird haben hat sie es ihr ihre ihren in im zu zum zur und oder nicht mit ohne auf bitte um le la les un une des du de d l en et ou à au aux ce cette ces est sont a ont pour par sur dans avec sans ne pas vous votre vos s il n
o os as um uma do da dos das em no na e ou que para com sem seu sua è sono il lo gli i un uno una di del della per con senza si e o non в на и или не с без для по к у это вы ваш ваша ваше ваши пожалуйста
"""
STOP_CJK = "的了是在请您你我他它们此这那里本该为以已被将会和与或及等后前再可并也就都而吗呢吧啊得着过给让把从向对于到上下中先才还又很较最个条些所其之か が の を に は で と も や へ し て た です ます"
#: Field nouns: a bracketed name that ends in one of them is a slot (fixed values).
FIELDS = set(
    "name names username firstname lastname surname nickname title subtitle headline brand model maker price cost amount total fee rate discount currency query keyword keywords option options budget reason id ids sku asin uid number no num count qty quantity size color colour spec "
    "weight date time day days month year hour hours deadline period email mail phone tel address street city state country zip postcode url link website domain company organization organisation department industry sector position job role user customer client recipient sender author owner manager "
    "product item shop store category service location place text content description message subject topic signature greeting page step persona placeholder variable value".split()
)
FIELDS_CJK = re.compile("(?:名|名称|姓名|昵称|标题|品牌|型号|价格|金额|单价|费用|折扣|颜色|规格|尺寸|数量|编号|号码|单号|日期|时间|天数|地址|城市|国家|电话|手机|邮箱|链接|网址|公司|部门|行业|职位|用户|客户|商品|产品|店铺|店名|类别|分类|预算|原因|理由|关键词|检索词|画像|页码|步数|次数|描述|内容|主题|备注)$")
_ID = r"[A-Za-z一-鿿][\w. ]*?"
#: Slots whose marks alone tell: the name may be anything.
STRONG_SLOT = re.compile(
    rf"\{{\{{+ ?{_ID} ?\}}\}}+|\{{\{{ ?[A-Za-z一-鿿]|<%=? ?{_ID} ?%>|\{{% ?{_ID} ?%\}}|\[\[+ ?{_ID} ?\]\]+|[$#]\{{ ?{_ID} ?\}}|@@{_ID}@@|__+ ?{_ID} ?__+"
    r"|%[A-Z][A-Z0-9_.]{2,}%|\$[A-Za-z][\w.]+\$|〈[^〈〉\n]+待补〉|【请填写?[^【】\n]+】|\((?:此处填|在此填写|请填写?)[^()\n]+\)|\([^()\n]+:待填写?\)|\((?i:your|insert|enter|add) [\w. ]+ here\)"
    r"|\[(?i:insert|enter|add|your) [\w. ]+\]|\[[\w. ]+ (?:TBD|tbd|TBC|tbc)\]|\bTODO: ?[a-z]|<(?:此处填|待填|请填写?)[^<>\n]+>|\{[a-z]+(?:_[a-z0-9]+)+\}|\{[a-z]+(?:[A-Z][a-z0-9]+)+\}"
)
#: Slots in everyday brackets: the name must end in a field noun.
WEAK_SLOT = re.compile(r"[{<\[]([A-Za-z_一-鿿][\w. ]*)[}>\]](?!\()")
#: Paired marks of quotation; a straight one opens before and closes after something that is no word.
_PAIRS = r"“[^“”]+”|「[^「」]+」|『[^『』]+』|《[^《》]+》|`[^`]+`"
_STRAIGHT = r"(?<!\w)\"(?=\S)[^\"]+\"(?!\w)"
_QUOTED = re.compile(rf"{_PAIRS}|{_STRAIGHT}")
#: A string where JSON has one; its own escapes belong to it.
_JSON = re.compile(r"([{\[,:]\s*)\"((?:[^\"\\]|\\.)*)\"(?=\s*([}\],:]))", re.S)
_KEYED = re.compile(r"\"\s*:\s*$")
_INNER = re.compile(rf"{_PAIRS}|\\\"[^\"]+\\\"")
_SPAN = re.compile(rf"{_PAIRS}|{_JSON.pattern}|{_STRAIGHT}", re.S)
_TAG = re.compile(r"</?(?:div|p|br|span|b|i|h[1-6]|a|li|ul|ol|pre|code|section|html|body|title|center|hr)\b[^<>]*>", re.I)
_ZERO = re.compile("[\u200b\u200c\u200d\u2060\ufeff\u00ad]")
_CUT = re.compile(r"(?<=[。！？!?\n])|(?<=\.)(?=\s|$)|(?<=;)")
#: Numbers of requests, error codes and the like are neither cover nor letters.
_CODES = re.compile(r"\((?:code )?\w*\d\w*\)|\[[0-9a-f]{4,40}\]|错误码:? ?\w+|编号:? ?\w+|(?:request id|reference|error code):? ?[\w-]*\d[\w-]*|\b\w+(?:/\w+)+(?:\.\w+)*|\d+", re.I)
_LETTER = re.compile(r"[^\W_]")


def _phrases(text: str) -> list[str]:
    return [unicodedata.normalize("NFKC", p).casefold() for line in text.strip().splitlines() for p in line.split("|") if p]


def _words(text: str) -> list[str]:
    return [unicodedata.normalize("NFKC", w).casefold() for w in text.split()]


@lru_cache(1)
def automaton():
    """The phrases of all kinds as one automaton."""
    import ahocorasick

    a = ahocorasick.Automaton()
    for kind, text in PHRASES.items():
        for p in _phrases(text):
            a.add_word(p, (kind, p))
    for p in ("lorem", "ipsum", "consectetur", "adipiscing", "eiusmod", "nostrud", "ullamco", "veniam", "irure", "cillum", "pariatur", "excepteur", "cupidatat", "aliqua"):
        a.add_word(p, ("filler", p))
    a.make_automaton()
    return a


def _spelled(words: list[str]) -> re.Pattern:
    """One pattern, longest first; words of scripts with blanks end at word borders."""
    spaced = lambda p: not re.search(r"[\u3040-\u30ff\u4e00-\u9fff\uac00-\ud7af]", p)
    whole = lambda p: ("(?<![a-z\u00df-\u024f\u0400-\u04ff])" if p[0].isalnum() else "") + re.escape(p) + ("(?![a-z\u00df-\u024f\u0400-\u04ff])" if p[-1].isalnum() else "")
    return re.compile("|".join(whole(p) if spaced(p) else re.escape(p) for p in sorted(set(words), key=len, reverse=True)))


@lru_cache(4)
def cover(kind: str) -> re.Pattern:
    names = r"\b\w+(?:error|exception)\b|" if kind == "error" else ""  # of program errors, such as TypeError
    return re.compile(names + _spelled(_phrases(PHRASES[kind]) + _words(WORDS[kind])).pattern)


@lru_cache(1)
def stop() -> re.Pattern:
    return re.compile(f"{_spelled(_words(STOP)).pattern}|[{STOP_CJK.replace(' ', '')}]")


def normalised(text: str) -> str:
    """NFKC without invisible characters and tags; case is kept."""
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = _ZERO.sub("", unicodedata.normalize("NFKC", text))
    return _TAG.sub("\n", text) if "<" in text else text


def unquoted(text: str) -> str:
    """Quotations within other words are blanked out; a text that is all quotation stays."""
    out = _QUOTED.sub("\u0001", text)
    return out if len(_LETTER.findall(out)) > 3 else text


def json_kept(text: str) -> str:
    """Quotations are blanked out as in ``unquoted``, but strings of JSON stay, without the quotations inside them."""
    last = -1

    def one(m: re.Match) -> str:
        nonlocal last
        lead = m[1]
        if lead is None:
            return "\u0001"
        mark, at = lead[0], m.start()
        key = mark in "{," and m[3] == ":"
        value = mark == ":" and m[3] in ",}" and _KEYED.search(text, max(0, at - 20), at + 1)
        item = m[3] in ",]" and (mark == "[" or (mark == "," and (m[3] == "]" or not text[last:at].strip())))
        if key or value or (item and (mark == "[" or last >= 0)):
            last = m.end()
            return f'{lead}"{_INNER.sub(chr(1), m[2])}"'
        return lead + "\u0001" if m[2] else m[0]

    return _SPAN.sub(one, text)


def is_repetition(text: str) -> bool:
    """A unit of 2 to 16 characters with letters four times or more in a row (long ones three times), or a longer passage three times in a row."""
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    for p in range(2, 17):
        if len(cp) < 3 * p or len(cp) < 12:
            break
        same = cp[p:] == cp[:-p]
        need = max(3 * p, 12 - p) if p < 5 else max(2 * p, 16)
        if np.count_nonzero(same) < need:
            continue
        edges = np.flatnonzero(np.diff(np.concatenate(([0], same.view(np.int8), [0]))))
        starts, ends = edges[::2], edges[1::2]
        for at in starts[(ends - starts) >= need]:
            unit = text[at : at + p]
            if len(set(filter(str.isalpha, unit.lower()))) >= 2 or (p >= 4 and len(_LETTER.findall(unit)) >= 3 and not unit.isdigit()):
                return True
    passages = [p for x in _CUT.split(text) if (p := x.strip())]
    return any(a == b == c and len(_LETTER.findall(a)) > 4 for a, b, c in zip(passages, passages[1:], passages[2:], strict=False))


def slot(text: str) -> bool:
    if STRONG_SLOT.search(text):
        return True
    for m in WEAK_SLOT.finditer(text):
        name = re.sub(r"(?<=[a-z])(?=[A-Z])", "_", m[1]).lower().strip().replace(" ", "_")
        name = re.sub(r"\d+$", "", name.rpartition(".")[2]).strip("_")
        if name.rpartition("_")[2] in FIELDS or FIELDS_CJK.search(name):
            return True
    return False


def passage_cover(passage: str, kind: str) -> float:
    """Share of the passage's content letters inside the kind's phrases and words."""
    s = _CODES.sub(" ", passage)
    letters = np.frombuffer(bytes(c.isalnum() for c in s), dtype=bool).copy()
    for m in stop().finditer(s):
        letters[m.start() : m.end()] = False
    inside = np.zeros(len(s), dtype=bool)
    for m in cover(kind).finditer(s):
        inside[m.start() : m.end()] = True
    n = int(letters.sum())
    return int((letters & inside).sum()) / n if n else 0.0


def found(text: str | None) -> str:
    """Kind of residue in a text: slot, repetition, error, script, filler, or '' for none."""
    if not text:
        return ""
    whole = normalised(text)
    t = unquoted(whole)
    if slot(json_kept(whole) if t != whole and '"' in whole else t):
        return "slot"
    low = t.casefold()
    done: set[tuple[int, str]] = set()
    cuts = None
    for end, (kind, phrase) in automaton().iter(low):
        start = end - len(phrase) + 1
        if (phrase not in ("error:", "exception:") and phrase[0].isalpha() and phrase[0] < "\u2e80" and start and low[start - 1].isalpha() and low[start - 1] < "\u2e80") or (
            phrase[-1].isalpha() and phrase[-1] < "\u2e80" and end + 1 < len(low) and low[end + 1].isalpha() and low[end + 1] < "\u2e80" and phrase != "cannot read propert"
        ):
            continue  # within a longer word
        if cuts is None:
            cuts = np.array([0, *(m.start() for m in _CUT.finditer(low)), len(low)])
        i = min(int(np.searchsorted(cuts, end, side="right")) - 1, len(cuts) - 2)
        if (i, kind) in done:
            continue
        done.add((i, kind))
        passage = low[cuts[i] : cuts[i + 1]]
        if "\u0001" not in passage and passage_cover(passage, kind) >= COVERAGE:
            return kind
    return "repetition" if is_repetition(low) else ""


@F.pandas_udf(T.StringType())
def _kind(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield texts.map(found)


def residue_kind(text: Column) -> Column:
    """Kind of residue as in ``found``; '' for none and for null."""
    return _kind(text)
