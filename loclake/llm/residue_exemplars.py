"""Labelled exemplars of residue: a label, then one exemplar a line. Numbers stand for any number."""

# Reason phrases of the HTTP standard.
REASONS = (
    "Bad Request", "Unauthorized", "Payment Required", "Forbidden", "Not Found", "Page Not Found", "Method Not Allowed", "Not Acceptable", "Proxy Authentication Required", "Request Timeout", "Conflict", "Gone",
    "Length Required", "Payload Too Large", "Request Entity Too Large", "URI Too Long", "Unsupported Media Type", "Expectation Failed", "Unprocessable Entity", "Locked", "Too Early", "Upgrade Required",
    "Too Many Requests", "Request Header Fields Too Large", "Unavailable For Legal Reasons", "Internal Server Error", "Not Implemented", "Bad Gateway", "Service Unavailable", "Service Temporarily Unavailable",
    "Gateway Timeout", "Gateway Time-out", "HTTP Version Not Supported", "Insufficient Storage", "Loop Detected", "Network Authentication Required", "Web Server Is Down", "Connection Timed Out", "Origin Is Unreachable",
)
#: Forms in which servers, clients and libraries show a reason.
FORMS = (
    "404 {}", "HTTP Error 404 {}", "Error 404 {} 1", "error code 404 message {}", "404 {} 404 {}", "404 {} Request ID: 404", "404 {} nginx", "404 {} 404 {} nginx", "HTTP 404: {}", "status 404 error {}", "status 404 title {}",
    "HTTP/1.1 404 {}", "{} (404)", "404 Client Error: {} for url", "404 Server Error: {} for url", "Request failed with status code 404 {}", "Error: {}", "Error: 404 {}", "404 {} cloudflare", "404 error {}", "success false error {}",
)

# Errors, notices and filler as servers, pages and templates have them.
TEXTS = """
error
Invalid response: unexpected token < in JSON at position 1
Unexpected token in JSON at position 1
Unexpected end of JSON input
Expecting value: line 1 column 1 (char 0)
Traceback (most recent call last)
TypeError: Cannot read properties of undefined
The service is temporarily overloaded, retry in 5 seconds.
The server is overloaded, please try again later.
This service is temporarily unavailable.
The server encountered an internal error and was unable to complete your request.
An unexpected error occurred.
An error occurred while processing your request.
Something went wrong, please try again later.
Something went wrong.
Internal error, please try again.
Quota exceeded for this project: 800 of 800 characters used.
You have exceeded your current quota, please check your plan and billing details.
Daily limit exceeded
Rate limit exceeded, please try again later.
Rate limit reached for requests
Character limit exceeded
Too many requests, please slow down.
Invalid API key
API key not valid. Please pass a valid API key.
Authentication failed
Connection timed out after 5 ms
Connection refused
Connection reset by peer
The request timed out.
Read timed out.
Network error
upstream connect error or disconnect/reset before headers
no healthy upstream
Access denied.
Access denied. Reference 1
Access denied. Our systems have detected unusual traffic from your network.
Our systems have detected unusual traffic from your network.
Our systems have detected unusual traffic from your network. Request 1
Your request has been blocked.
Sorry, you have been blocked.
You don't have permission to access this resource.
Please complete the captcha to continue.
Please verify that you are not a robot.
Verify you are human by completing the action below.
Checking your browser before accessing the site.
Your session has expired, please sign in again.
The requested page could not be found.
The requested URL was not found on this server.
The site is under maintenance, please come back later.
Translation failed
Translation service error
Unable to translate
Une erreur interne est survenue. Réf. 1
Une erreur interne est survenue.
Une erreur est survenue, veuillez réessayer plus tard.
Une erreur inattendue s'est produite.
Page non trouvée
La page demandée est introuvable.
La page demandée n'existe pas.
Erreur interne du serveur
Service temporairement indisponible
Accès refusé.
Trop de requêtes
Délai d'attente dépassé
Die angeforderte Seite wurde nicht gefunden (Code 1).
Die angeforderte Seite wurde nicht gefunden.
Seite nicht gefunden
Interner Serverfehler
Ein interner Fehler ist aufgetreten
Es ist ein unerwarteter Fehler aufgetreten.
Ein Fehler ist aufgetreten, bitte versuchen Sie es später erneut.
Der Dienst ist vorübergehend nicht verfügbar.
Zugriff verweigert.
Zu viele Anfragen
Zeitüberschreitung der Anforderung
Ha ocurrido un error inesperado, código 1.
Ha ocurrido un error inesperado.
Se ha producido un error, inténtelo de nuevo más tarde.
Se produjo un error interno.
Página no encontrada
La página solicitada no existe.
Error interno del servidor
Servicio no disponible temporalmente
Acceso denegado.
Demasiadas solicitudes
Tiempo de espera agotado
Sayfa bulunamadı. İstek numarası 1
Sayfa bulunamadı.
İstenen sayfa bulunamadı.
Beklenmeyen bir hata oluştu
Bir hata oluştu, lütfen daha sonra tekrar deneyin.
Sunucu hatası
Sunucu iç hatası
Hizmet geçici olarak kullanılamıyor.
Erişim engellendi.
Çok fazla istek
Bağlantı zaman aşımına uğradı
Произошла внутренняя ошибка сервера, запрос 1.
Произошла внутренняя ошибка сервера
Произошла непредвиденная ошибка.
Произошла ошибка, повторите попытку позже.
Внутренняя ошибка сервера
Страница не найдена
Запрошенная страница не найдена.
Сервис временно недоступен
Доступ запрещён.
Слишком много запросов
Превышено время ожидания
サーバーエラーが発生しました（1）。
サーバーエラーが発生しました
内部サーバーエラー
予期しないエラーが発生しました
エラーが発生しました。しばらくしてからもう一度お試しください。
ページが見つかりません
お探しのページは見つかりませんでした
サービスは一時的に利用できません
アクセスが拒否されました
リクエストが多すぎます
接続がタイムアウトしました
scripts
You need to enable JavaScript to run this app.
Please enable JavaScript to continue.
Please enable JavaScript and cookies to continue.
Enable JavaScript and cookies to continue
JavaScript is disabled in your browser. Turn it on and reload the page.
JavaScript is disabled in your browser.
Turn it on and reload the page.
JavaScript must be enabled to view this page.
Your browser does not support JavaScript.
This page requires scripts.
This page requires JavaScript.
This site requires JavaScript.
This site works only with JavaScript.
Please turn on scripts in your browser.
Veuillez activer JavaScript pour continuer.
Veuillez activer JavaScript dans votre navigateur pour afficher cette page.
JavaScript est désactivé dans votre navigateur.
Ce site nécessite JavaScript.
Bitte aktivieren Sie JavaScript, um diese Seite zu nutzen.
Bitte aktivieren Sie JavaScript in Ihrem Browser.
JavaScript ist in Ihrem Browser deaktiviert.
Diese Seite benötigt JavaScript.
Active JavaScript en su navegador para ver esta página.
Habilite JavaScript en su navegador para ver esta página.
Es necesario activar JavaScript para continuar.
Esta página requiere JavaScript.
Bu sayfayı görüntülemek için JavaScript etkinleştirilmelidir.
Devam etmek için lütfen JavaScript'i etkinleştirin.
Tarayıcınızda JavaScript devre dışı.
Bu site JavaScript gerektirir.
Для работы страницы включите JavaScript в браузере.
Пожалуйста, включите JavaScript, чтобы продолжить.
В вашем браузере отключён JavaScript.
Для просмотра этой страницы необходим JavaScript.
このページを表示するにはJavaScriptを有効にしてください。
続行するにはJavaScriptを有効にしてください
お使いのブラウザではJavaScriptが無効になっています
filler
Lorem ipsum dolor sit amet, consectetur adipiscing elit.
Lorem ipsum dolor sit amet
Lorem ipsum
dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor
sed do eiusmod tempor incididunt ut labore et dolore magna aliqua
Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat
Duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur
Excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia deserunt mollit anim id est laborum
The quick brown fox jumps over the lazy dog
Your text here
Your text goes here
Your translation here
Insert text here
Insert translation here
Enter text here
Enter your text
Type your text here
Type here
Add text here
Text here
Text goes here
Content goes here
Click to add text
Replace this text
Replace me
Placeholder text
Placeholder
Sample text sample text
Sample text
Example text
Dummy text
Test text
test test test
test test
asdf asdf asdf
asdf asdf
asdf
asdfgh
qwerty
qwerty qwerty
xxxx xxx xxxxx
xxx xxx xxx
xxx
foo bar baz
foo bar
blah blah blah
bla bla bla
TBD
TBA
TODO
FIXME
WIP
TODO: translate this line
TODO translate
TODO: translation
FIXME translation
FIXME: translate
Missing translation
Translation missing
Translation pending
Translation goes here
Awaiting translation
To be translated
Needs translation
No translation
No translation available
Not translated
Not yet translated
Untranslated
Insert name
Insert name here
Your name here
Translate me
String not found
Texte à insérer ici
Votre texte ici
Insérez votre texte ici
Saisissez votre texte ici
Texte d'exemple
Texte de remplissage
À traduire
Traduction manquante
Hier Text einfügen
Hier Text eingeben
Ihr Text hier
Hier steht Ihr Text
Text hier eingeben
Beispieltext
Blindtext
Platzhaltertext
Platzhalter
Noch zu übersetzen
Übersetzung fehlt
Metni buraya yazın
Metni buraya girin
Metninizi buraya yazın
Buraya metin girin
Örnek metin
Yer tutucu metin
Çevrilecek
Çeviri eksik
Inserte el texto aquí
Inserte su texto aquí
Introduzca el texto aquí
Su texto aquí
Tu texto aquí
Escriba el texto aquí
Texto de ejemplo
Texto de relleno
Pendiente de traducir
Traducción pendiente
Falta la traducción
Введите текст
Введите текст здесь
Вставьте текст сюда
Вставьте текст здесь
Ваш текст здесь
Здесь будет текст
Пример текста
Образец текста
Перевод отсутствует
Нужен перевод
ここにテキストを入力
ここにテキストを入力してください
テキストを入力してください
ここに文章が入ります
ここにテキストが入ります
サンプルテキスト
ダミーテキスト
仮テキスト
未翻訳
翻訳待ち
"""


def labelled() -> list[tuple[str, str]]:
    """(label, exemplar) of all of them."""
    out, label = [("error", f.replace("{}", r)) for r in REASONS for f in FORMS], ""
    for line in TEXTS.strip().split("\n"):
        if line in ("error", "scripts", "filler"):
            label = line
        else:
            out.append((label, line))
    return out
