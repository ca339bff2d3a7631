"""Template residue, filler and notices of failed pages in documents (problem 9).

Labelled exemplars are indexed by their terms. A document is cut into passage windows (sentences, and whatever stands
between marks inside one); the inverted index retrieves, through each exemplar's rarest terms, the exemplars that a
window can match, and the TF-IDF containment of window and exemplar decides. Terms are the first letters of words, so
that inflected and reworded messages still meet, pairs of neighbouring ideographs and syllables, and, for what stands
between marks, its shape: ``{{ title }}`` and ``{{name}}`` share the term ``{{a}}``. Exemplars labelled 'mention' speak
about such things and keep a sentence that covers them.

Documents are cut once. What a window holds of the index is kept (one row a document, checkpointed), and both the weights
and the matches come from that. Weights are inverse document frequencies over the windows of the whole corpus. The index
is bounded by the list of exemplars, so it is broadcast; texts are not shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from subtide.functions.columns import let
from subtide.session import durable

PLACEHOLDER, MENTION = "placeholder", "mention"
#: Stands in an exemplar of talk about placeholders where one may be.
SLOT = "xslotx"

#: Placeholders of common template languages and of forms to fill in.
PLACEHOLDERS = (
    "{{name}}", "{{{name}}}", "{{ name }}", "{{ object.name }}", "{{ name | default('') }}", "{{ name|default }}", "{% block name %}", "{name}", "${name}", "${object.name}", "#{name}", "<%= name %>", "<% name %>", "<%=name%>", "[%name%]", "[% name %]", "%%NAME%%", "%%name%%", "__NAME__", "@@name@@",
    "@@NAME@@", "[[name]]", "[[NAME]]", "%(name)s", "%(name)d", "<name>", "<NAME>", "<first_name>", "{NAME}", "{Name}", "{{NAME}}", "${NAME}", "[YOUR NAME]", "[FIRST NAME]", "[COMPANY NAME]", "[INSERT DATE]", "[INSERT TEXT HERE]", "[PAGE TITLE]", "[YOUR TEXT HERE]", "[TITLE GOES HERE]", "[EPISODE TITLE]", "[RELEASE DATE]", "[PHONE NUMBER]", "[EMAIL ADDRESS]", "[Your name]", "[Insert title here]", "[Enter text]",
    "[Add link]", "[Fill in]", "<your name here>", "<insert text here>", "(insert name here)", "【此处填写】", "【请填写】", "【请输入】", "【在此输入】", "【待填写】", "【待补充】", "【插入】", "（待补充）", "（待填写）", "（待定）", "（此处填写）", "（请填写）", "[此处填写]", "[待补充]", "[请输入]", "{姓名}", "{标题}", "{{姓名}}", "${标题}",
)
#: Talk about placeholders.
MENTIONS = (
    f"the macro fills in the {SLOT} field", f"the field {SLOT} is filled automatically", f"the script replaces {SLOT}", f"the placeholder {SLOT} means", f"a variable called {SLOT}", f"the template uses {SLOT} as a variable", f"the tag {SLOT} moves the line", f"the syntax {SLOT} is replaced on export", f"write {SLOT} in the script", f"标签 {SLOT} 的意思是", f"占位符 {SLOT} 会自动替换", f"变量 {SLOT} 由脚本填入",
)
#: The filler text that typesetters use, in short phrases, its usual continuation, and other filler.
FILLERS = (
    "lorem ipsum", "lorem ipsum dolor", "ipsum dolor sit amet", "consectetur adipiscing elit", "sed do eiusmod tempor", "tempor incididunt ut labore", "et dolore magna aliqua", "ut enim ad minim", "minim veniam quis nostrud", "nostrud exercitation ullamco", "ullamco laboris nisi", "nisi ut aliquip ex ea", "ea commodo consequat", "duis aute irure dolor", "in reprehenderit in voluptate", "velit esse cillum", "eu fugiat nulla pariatur",
    "excepteur sint occaecat", "cupidatat non proident", "sunt in culpa", "qui officia deserunt", "mollit anim id est laborum", "sed ut perspiciatis unde omnis", "iste natus error sit voluptatem", "accusantium doloremque laudantium", "totam rem aperiam eaque ipsa", "nemo enim ipsam voluptatem", "quia voluptas sit aspernatur", "neque porro quisquam est", "qui dolorem ipsum", "quis autem vel eum iure", "at vero eos et accusamus",
    "temporibus autem quibusdam", "rerum necessitatibus saepe", "itaque earum rerum hic tenetur", "vestibulum ante ipsum primis", "pellentesque habitant morbi tristique", "blandit aliquam etiam erat", "aenean commodo ligula eget", "this is placeholder text", "this is sample text", "this is dummy text", "sample text", "your text here", "text goes here", "replace this text before publishing", "insert text here",
    "the quick brown fox jumps over the lazy dog", "asdf asdf asdf", "test test test", "foo bar baz", "undefined undefined", "null null null", "NaN NaN NaN", "[object Object]", "no description available", "to be announced", "占位文本", "占位文字", "替换为正文内容", "示例段落", "上线前请删除", "请在此处输入正文", "此处填写内容", "内容待补充", "这里是示例文字", "测试文本测试文本", "示例文本", "发布前替换", "敬请期待",
)
#: Usual wordings of servers, frameworks, sites and browsers, by kind.
NOTICES = {
    "error_page": (
        "400 Bad Request", "401 Unauthorized", "402 Payment Required", "403 Forbidden", "404 Not Found", "Error 404", "HTTP 404", "HTTP error 500", "405 Method Not Allowed", "408 Request Timeout", "410 Gone", "429 Too Many Requests", "500 Internal Server Error", "501 Not Implemented", "502 Bad Gateway", "503 Service Unavailable", "503 Service Temporarily Unavailable", "504 Gateway Timeout", "The requested URL was not found on this server",
        "The page you requested could not be found", "The page you are looking for does not exist", "The page may have been moved or deleted", "Page not found", "The server encountered an internal error and was unable to complete your request", "The proxy server received an invalid response from an upstream server", "The server is temporarily unable to service your request due to maintenance", "Something went wrong", "Something went wrong while loading this page",
        "Oops something went wrong", "Oops", "An unexpected error has occurred", "Please try again later", "Please try again in a few minutes", "Please refresh the page and try again", "Down for maintenance", "The site is down for scheduled maintenance", "We will be back soon", "Check back later", "This content is no longer available", "This page is no longer available", "This video is unavailable", "This video has been removed by the uploader",
        "This content was removed at the request of the owner", "Removed following a copyright claim", "This content is not available in your country or region", "This site is closed to visitors from your region", "This domain is parked", "This domain is for sale", "This account has been suspended", "Traceback (most recent call last)", 'File "main.py", line 10, in run', "KeyError: 'name'", "ValueError: invalid literal", "TypeError: undefined is not a function", "NullPointerException at line 10", "Exception in thread main",
        "Fatal error: uncaught exception on line 10", "Warning: undefined variable on line 10", "Stack trace", "Segmentation fault", "The request timed out", "Request timed out after 30 seconds", "Connection timed out", "Connection refused", "Connection reset by peer", "This site can't be reached", "No internet connection", "Error establishing a database connection", "Database connection failed", "Invalid request", "Invalid or expired token", "Missing parameter", "Error code 1001", "Request ID 1001",
        "Reference number 1001", "页面不存在", "您访问的页面不存在", "很抱歉，您要访问的页面不存在", "该页面已被删除", "页面已被删除或移动", "页面走丢了", "找不到您要的页面", "几秒后自动返回首页", "将在 5 秒后返回上一页", "返回上一页", "服务器内部错误", "服务器错误", "服务器繁忙，请稍后再试", "系统繁忙，请稍后重试", "网络异常，请刷新重试", "请求超时", "错误代码 500", "该内容已被删除", "该内容已下架", "该视频暂时无法播放", "视频无法播放", "网站维护中，请稍后访问", "系统维护中",
        "加载失败，请重试", "出错了", "您所在的地区无法观看", "应版权方要求已下架", "頁面不存在", "找不到網頁", "系統忙碌中，請稍後再試", "お探しのページは見つかりませんでした", "ページが見つかりません", "エラーが発生しました", "しばらくしてからもう一度お試しください", "ただいまメンテナンス中です", "페이지를 찾을 수 없습니다", "오류가 발생했습니다", "잠시 후 다시 시도해 주세요", "Страница не найдена", "Произошла ошибка", "Повторите попытку позже", "Página no encontrada", "Ha ocurrido un error",
        "Inténtelo de nuevo más tarde", "Página não encontrada", "Page introuvable", "Une erreur est survenue", "Veuillez réessayer plus tard", "Seite nicht gefunden", "Ein Fehler ist aufgetreten", "Bitte versuchen Sie es später erneut", "Không tìm thấy trang", "Đã xảy ra lỗi", "Sayfa bulunamadı", "Bir hata oluştu",
    ),
    "access": (
        "Access denied", "Permission denied", "You don't have permission to access this resource", "You do not have permission to view this page", "You are not authorized to view this page", "Please log in to continue", "Please sign in to view this content", "Log in to see this page", "Your session has expired", "Please log in again", "Subscribe to continue reading", "This content is for members only", "Too many requests",
        "You have been rate limited", "Slow down and try again in a minute", "Sorry, you have been blocked", "Your IP address has been blocked", "Please verify you are a human", "Verify that you are human by completing the action below", "Verifying that you are not a robot", "Tick the box to confirm you are not a robot", "Checking your browser before accessing the site", "This process is automatic", "This may take a few seconds", "Complete the security check to continue", "登录已过期，请重新登录",
        "请登录后查看", "请先登录", "您没有权限访问此页面", "无权访问该内容", "仅限会员观看", "访问被拒绝", "访问过于频繁，请稍后再试", "请完成验证以继续", "请输入验证码", "正在检查您的浏览器", "請先登入", "您沒有權限", "ログインしてください", "アクセスが拒否されました", "閲覧する権限がありません", "로그인이 필요합니다", "접근 권한이 없습니다", "Доступ запрещён", "Войдите, чтобы продолжить", "Acceso denegado", "Inicie sesión para continuar", "Accès refusé", "Veuillez vous connecter pour continuer", "Zugriff verweigert",
        "Bitte melden Sie sich an", "Truy cập bị từ chối", "Erişim engellendi",
    ),
    "consent": (
        "We use cookies", "Accept all cookies to continue", "Accept cookies", "This website uses cookies to improve your experience", "By continuing to use this site you agree to our use of cookies", "Manage your cookie preferences", "Please accept our cookie policy", "We value your privacy", "我们使用 Cookie", "本网站使用 Cookie 改善您的体验", "继续浏览即表示您同意我们使用 Cookie", "请接受所有 Cookie", "接受所有 Cookie", "本網站使用 Cookie", "当サイトではクッキーを使用しています", "Cookieの使用に同意する",
        "이 웹사이트는 쿠키를 사용합니다", "Мы используем файлы cookie", "Utilizamos cookies", "Aceptar todas las cookies", "Nous utilisons des cookies", "Accepter tous les cookies", "Wir verwenden Cookies", "Alle Cookies akzeptieren",
    ),
    "loading": (
        "Loading", "Loading please wait", "Please wait", "Please wait while the page is loading", "Please wait while we load the content", "You are being redirected", "Redirecting", "Redirecting to the home page", "If you are not redirected click here", "Just a moment", "正在加载", "加载中", "加载中请稍候", "请稍候", "正在跳转", "页面跳转中", "載入中", "読み込み中", "しばらくお待ちください", "로딩 중", "잠시만 기다려 주세요", "Загрузка", "Подождите", "Cargando", "Chargement en cours",
        "Wird geladen", "Đang tải", "Yükleniyor",
    ),
    "script": (
        "Please enable JavaScript to view this page", "Enable JavaScript to continue", "You need to enable JavaScript to run this app", "JavaScript is disabled in your browser", "JavaScript is required", "This page requires JavaScript", "This site requires scripts to work", "This site needs JavaScript", "Turn on JavaScript in your browser and reload the page", "Scripts are turned off in your browser", "Your browser does not support JavaScript", "Your browser does not support this feature", "Your browser is out of date",
        "Please upgrade your browser to view this content", "Please switch on scripting", "This page will stay blank without scripts", "Please disable your ad blocker", "请启用 JavaScript", "请在浏览器中启用 JavaScript", "您的浏览器不支持 JavaScript", "您的浏览器版本过低，请升级", "本页面需要启用脚本", "需要 JavaScript 才能浏览", "請啟用 JavaScript", "您的瀏覽器不支援", "このページを表示するにはJavaScriptを有効にしてください", "スクリプトを有効にしてください", "お使いのブラウザはサポートされていません",
        "이 페이지를 보려면 자바스크립트를 활성화하세요", "스크립트를 사용하도록 설정하세요", "Включите JavaScript в браузере", "Для просмотра страницы включите JavaScript", "Habilite JavaScript para ver esta página", "Active JavaScript en su navegador", "Veuillez activer JavaScript pour afficher cette page", "Bitte aktivieren Sie JavaScript", "Vui lòng bật JavaScript", "Lütfen JavaScript'i etkinleştirin",
    ),
}
EXEMPLARS: tuple[tuple[str, str], ...] = tuple(
    [(PLACEHOLDER, t) for t in PLACEHOLDERS] + [(MENTION, t) for t in MENTIONS] + [("filler", t) for t in FILLERS] + [(kind, t) for kind, texts in NOTICES.items() for t in texts]
)

#: Containment from which a window is residue: most of its weight; how much of an exemplar must be there to count.
CONTAINED, COVERED, MENTIONED = 0.5, 0.45, 0.5
#: Names of markup that subtitles hold.
MARKUP = ("i", "b", "u", "s", "em", "br", "p", "tt", "rt", "font", "span", "ruby", "center", "small", "big", "strong", "code", "div")
#: What stands between marks: a run of opening ones, a short body, a run of closing ones.
SPAN = r"[%$]?\([^()\n]{1,60}\)|(?:[\[{<%@#$【（]{1,3}=?|__)[^\[\]{}<>%@#$【】（）\n]{1,60}?(?:[\]}>%@】）]{1,3}|__)"
STEM = 5
#: Letters of words (Latin with its accents and marks, Cyrillic), and what is written without spaces. Ranges, as
#: a look at the script of every character costs much more.
LETTERS = r"a-z'\x{DF}-\x{24F}\x{300}-\x{36F}\x{400}-\x{52F}\x{1E00}-\x{1EFF}"
GLUED = r"\x{3040}-\x{30FF}\x{3400}-\x{9FFF}\x{AC00}-\x{D7AF}"


def _words(low: Column) -> Column:
    """Stems of words, numbers (as one term) and pairs of neighbouring ideographs or syllables of a lower-case text."""
    words = F.transform(F.regexp_extract_all(low, F.lit(rf"[{LETTERS}]+|\d+"), F.lit(0)), lambda w: F.when(w.between("0", "9￿"), F.lit("0")).otherwise(F.substring(F.rtrim(w, F.lit("s")), 1, STEM)))
    pairs = F.when(low.rlike(f"[{GLUED}]"), F.regexp_extract_all(low, F.lit(rf"(?=([{GLUED}]{{2}}))"), F.lit(1))).otherwise(F.array().cast("array<string>"))
    return F.filter(F.concat(words, pairs), lambda w: w != "")


def terms(passage: Column) -> Column:
    """Distinct terms of a sentence."""
    return F.array_distinct(_words(F.lower(F.translate(passage, "’", "'"))))


def span_terms(span: Column) -> Column:
    """Distinct terms of what stands between marks. A name alone, with or without a filter, is one term: its shape. Anything
    else is its marks and what its body begins with (two words or four ideographs), where a form says what it wants."""
    marks = F.regexp_replace(span, r"[^\[\]{}<>%@#$【】（）()_=]+|(?<=\p{Alnum})_(?=\p{Alnum})", "")
    name = span.rlike(r"^[\[{<%@#$(_]+=?\s*(?:[a-z][a-z0-9_.]{2,40}|[A-Z][A-Za-z0-9_]{1,40})\s*(?:\|[^|]{1,30})?[\]}>%@)_]+$")
    prose = (F.length(F.regexp_replace(marks, "_", "")) == 2) & span.startswith("[") & ~span.contains("_")  # [Music], [MUSIC]
    case = F.when(span.rlike("[a-z]"), "a").otherwise("A")
    body = F.array_distinct(F.slice(_words(F.lower(F.regexp_replace(span, "[_%]", " "))), 1, F.when(span.rlike(f"[{GLUED}]"), 3).otherwise(2)))
    shape = F.concat(F.regexp_replace(marks, r"\(\)(?=.)", ""), case)
    return F.when(name & ~prose, F.array(shape)).otherwise(F.concat(F.array(marks), body))


def sentences(text: Column) -> Column:
    """Sentences and lines; bars part them where they part entries of a menu."""
    return F.filter(F.split(text, r"[\n。！？]+|(?<=[.!?…])\s+|……|\s\|\s(?![^{}\n]{0,40}\})"), lambda p: p.rlike(r"[\p{L}\p{N}]"))


def spans(sentence: Column) -> Column:
    """What stands between marks in a sentence, without markup; a sentence that closes a tag holds markup."""
    found = F.regexp_extract_all(sentence, F.lit(SPAN), F.lit(0))
    kept = F.filter(found, lambda s: ~s.rlike(r"(?i)^</?(?:" + "|".join(MARKUP) + r")\b|^</") & ~(sentence.contains("</") & s.startswith("<") & ~s.startswith("<%")))
    return F.when(sentence.rlike(r"[\[{<%@#$【（(]|__"), kept).otherwise(F.array().cast("array<string>"))


def exemplar_terms(spark: SparkSession, exemplars: tuple[tuple[str, str], ...] = EXEMPLARS) -> list[tuple[int, str, list[str]]]:
    """(number, label, terms) of each exemplar, by the same expressions as the documents; bounded by the exemplars."""
    schema = T.StructType([T.StructField("n", T.IntegerType()), T.StructField("label", T.StringType()), T.StructField("text", T.StringType())])
    rows = spark.createDataFrame([(n, label, text) for n, (label, text) in enumerate(exemplars)], schema)
    t = F.when(F.col("label") == PLACEHOLDER, span_terms(F.get(spans(F.col("text")), F.lit(0)))).otherwise(F.filter(terms(F.col("text")), lambda x: x != SLOT[:STEM]))
    return [(r.n, r.label, list(r.t)) for r in rows.select("n", "label", t.alias("t")).collect() if r.t]


def windows(documents: DataFrame, known: list[str]) -> DataFrame:
    """One row per document with text: n (its windows) and held, the windows that hold a term of the index, each with
    those terms, the number of its other terms, and, under ``slots``, the same of what stands between marks in it."""

    def of(t: Column) -> Column:
        return let(t, lambda x: let(F.filter(x, lambda y: y.isin(*known)), lambda k: F.struct(k.alias("known"), (F.size(x) - F.size(k)).alias("other"))))

    def window(sentence: Column) -> Column:
        return F.struct(of(terms(sentence)).alias("w"), F.transform(spans(sentence), lambda s: of(span_terms(s))).alias("slots"))

    every = F.transform(sentences(F.col("text")), window)
    holds = lambda w: (F.size(w["w"]["known"]) > 0) | F.exists(w["slots"], lambda s: F.size(s["known"]) > 0)
    rows = documents.filter("doc_id is not null and text is not null").select("doc_id", every.alias("every"))
    return rows.select("doc_id", F.size("every").alias("n"), F.filter("every", holds).alias("held"))


def weigh(cut: DataFrame, known: list[str]) -> tuple[dict[str, float], float]:
    """Inverse document frequencies of the index terms over all windows, and the weight of any other term."""
    one = F.explode(F.flatten(F.transform("held", lambda w: F.concat(w["w"]["known"], F.flatten(F.transform(w["slots"], lambda s: s["known"]))))))
    counted = {r.term: r.n for r in cut.select(one.alias("term")).groupBy("term").agg(F.count("*").alias("n")).collect()}  # one row per term
    total = cut.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    idf = {k: math.log((max(total, counted.get(k, 0)) + 1) / (counted.get(k, 0) + 1)) + 1 for k in known}
    return idf, sum(idf.values()) / max(1, len(idf))


def matches(documents: DataFrame, exemplars: tuple[tuple[str, str], ...] = EXEMPLARS) -> DataFrame:
    """doc_id, passage, slot, labels, containment, mentioned: windows (slot 0: the sentence, else what stands between
    marks in it, by number) and what they match.

    containment is the share of the window's weight that lies in exemplars of which it covers at least COVERED; labels
    are theirs. mentioned: it covers MENTIONED of an exemplar of talk about placeholders.
    """
    spark = documents.sparkSession
    index = exemplar_terms(spark, exemplars)
    known = sorted({t for _, _, ts in index for t in ts})
    cut = durable(windows(documents, known))
    idf, other = weigh(cut, known)
    listed, anchors = [], {}
    for n, label, ts in index:
        whole = sum(idf[t] for t in ts)
        listed.append((n, label, float(whole), ts))
        # A window without any anchor covers less than COVERED (or MENTIONED) of the exemplar.
        least, left = (MENTIONED if label == MENTION else COVERED) * whole, whole
        for t in sorted(ts, key=lambda t: (-idf[t], t)):
            if left < least:
                break
            anchors.setdefault(t, []).append(n)
            left -= idf[t]
    # The inverted index and the exemplars, both bounded by the list of exemplars.
    postings = spark.createDataFrame([(t, n) for t, ns in anchors.items() for n in ns], "term string, n int")
    texts = spark.createDataFrame(listed, "n int, label string, whole double, et array<string>")
    each = cut.select("doc_id", F.posexplode("held").alias("passage", "h")).select("doc_id", "passage", F.posexplode(F.concat(F.array("h.w"), "h.slots")).alias("slot", "s"))
    hit = each.select("doc_id", "passage", "slot", F.col("s.known").alias("t"), F.col("s.other").alias("other"), F.explode(F.filter("s.known", lambda x: x.isin(*anchors))).alias("term"))
    met = hit.join(F.broadcast(postings), "term").select("doc_id", "passage", "slot", "t", "other", "n").join(F.broadcast(texts), "n").filter((F.col("label") == PLACEHOLDER) == (F.col("slot") > 0))
    weights = F.create_map(*[F.lit(x) for k in known for x in (k, idf[k])])
    weight = lambda ts: F.aggregate(ts, F.lit(0.0), lambda a, t: a + F.coalesce(F.try_element_at(weights, t), F.lit(0.0)))
    met = met.withColumn("both", F.array_intersect("t", "et")).withColumn("coverage", weight(F.col("both")) / F.col("whole"))
    met = met.filter((F.col("coverage") >= COVERED) | ((F.col("label") == MENTION) & (F.col("coverage") >= MENTIONED)))
    real = F.col("label") != MENTION
    grouped = met.groupBy("doc_id", "passage", "slot").agg(
        F.first("t").alias("t"), F.first("other").alias("other"), F.collect_set(F.when(real, F.col("label"))).alias("labels"), F.flatten(F.collect_set(F.when(real, F.col("both")))).alias("covered"), F.bool_or(~real & (F.col("coverage") >= MENTIONED)).alias("mentioned")
    )  # at most one row per exemplar in a group
    return grouped.select("doc_id", "passage", "slot", "labels", (weight(F.array_distinct("covered")) / (weight(F.col("t")) + F.col("other") * other)).alias("containment"), "mentioned")


def residue(documents: DataFrame, exemplars: tuple[tuple[str, str], ...] = EXEMPLARS) -> DataFrame:
    """doc_id, labels: the documents that consist of or contain residue, and of which kinds.

    A sentence is residue if at least ``CONTAINED`` of its weight lies in exemplars of which it covers at least
    ``COVERED``; what stands between marks is likewise, unless its sentence covers ``MENTIONED`` of an exemplar of
    talk about such things. Null and blank texts, and passages without letters or digits, are no case. Repeated doc_ids
    are one case; further columns are not read; an empty table gives no rows.
    """
    m = matches(documents, exemplars)
    by = m.groupBy("doc_id", "passage").agg(
        F.bool_or(F.col("mentioned")).alias("mentioned"),
        F.flatten(F.collect_set(F.when((F.col("slot") == 0) & (F.col("containment") >= CONTAINED), F.col("labels")))).alias("said"),
        F.flatten(F.collect_set(F.when((F.col("slot") > 0) & (F.col("containment") >= CONTAINED), F.col("labels")))).alias("left"),
    )  # at most one distinct row per set of labels
    labels = F.concat("said", F.when(F.coalesce("mentioned", F.lit(False)), F.array().cast("array<string>")).otherwise(F.col("left")))
    return by.select("doc_id", F.explode(labels).alias("label")).groupBy("doc_id").agg(F.array_sort(F.collect_set("label")).alias("labels"))


def without_residue(documents: DataFrame, exemplars: tuple[tuple[str, str], ...] = EXEMPLARS) -> DataFrame:
    """The documents that are no case, as they are; documents with a null doc_id are kept."""
    return documents.join(residue(documents, exemplars).select("doc_id"), "doc_id", "left_anti")
