"""Texts with labels for residue, worded apart from the rules: none was used to make or mend them.

POSITIVE and NEGATIVE are base texts; `cases` sets each alone and among navigation or, where a text
is a field or an ordinary one, amid ordinary sentences.
"""

from __future__ import annotations

PAGES = [
    # scripts
    "This application uses JavaScript heavily. Kindly switch JavaScript on in your browser settings.",
    "JavaScript appears to be turned off in your browser. Enable it and reload this page.",
    "Sorry, this website does not work without JavaScript.",
    "Your browser has scripts blocked. Allow scripts to view the content.",
    "We're sorry but bank-portal doesn't work properly without JavaScript enabled. Please enable it to continue.",
    "자바스크립트 기능이 꺼져 있습니다. 브라우저에서 자바스크립트를 활성화해 주세요.",
    "자바스크립트를 켜야 이 사이트를 이용하실 수 있습니다.",
    "스크립트 사용이 제한되어 화면을 볼 수 없습니다. 스크립트를 허용해 주십시오.",
    "원활한 이용을 위해 JavaScript를 사용하도록 설정해 주시기 바랍니다.",
    "Trình duyệt của bạn đang tắt JavaScript. Hãy bật JavaScript để tiếp tục.",
    "Trang web này yêu cầu JavaScript.",
    # missing pages
    "404 - Page not found. The link you followed may be broken.",
    "Sorry, the page you are looking for does not exist.",
    "Oops! We can't find that page.",
    "The requested URL was not found on this server.",
    "This document has been removed or is no longer available.",
    "페이지가 존재하지 않습니다. 입력하신 주소를 다시 확인해 주세요.",
    "죄송합니다. 찾으시는 페이지가 없습니다.",
    "삭제되었거나 이동된 게시글입니다.",
    "해당 문서를 찾지 못했습니다. 경로를 확인하시기 바랍니다.",
    "존재하지 않는 상품입니다.",
    "Không tìm thấy trang bạn yêu cầu.",
    # failures
    "An unexpected error has occurred. Our team has been notified.",
    "Internal Server Error. The server encountered an internal error and was unable to complete your request.",
    "502 Bad Gateway nginx",
    "504 Gateway Time-out",
    "The server is not responding. Try again later.",
    "Unable to load content. Check your connection and refresh the page.",
    "Application error: a client-side exception has occurred.",
    "시스템 오류입니다. 잠시 뒤에 다시 시도해 주세요.",
    "서버에서 응답이 없습니다. 나중에 다시 이용해 주시기 바랍니다.",
    "요청을 처리하는 중 오류가 발생했습니다. 오류 코드: 5003",
    "알 수 없는 오류로 페이지를 표시할 수 없습니다.",
    "통신 장애로 정보를 가져오지 못했습니다. 다시 시도하십시오.",
    "Đã xảy ra lỗi. Vui lòng thử lại sau.",
    "java.lang.IllegalStateException: pool closed\n\tat com.bank.Pool.get(Pool.java:88)\n\tat com.bank.View.render(View.java:12)",
    "Traceback (most recent call last):\n  File \"app.py\", line 7, in main\nTypeError: unsupported operand",
    "Warning: mysqli_connect(): Access denied for user 'web'@'localhost' in /var/www/index.php on line 14",
    "Uncaught ReferenceError: render is not defined",
    # maintenance, load, access
    "We are currently undergoing scheduled maintenance. We'll be back shortly.",
    "Our site is down for maintenance. Please check back soon.",
    "서비스 점검 안내: 현재 서버 점검으로 이용이 중단되었습니다.",
    "홈페이지 개편 작업으로 서비스를 일시 중단합니다. 이용에 불편을 드려 죄송합니다.",
    "Hệ thống đang bảo trì. Vui lòng quay lại sau.",
    "You do not have permission to access this resource.",
    "403 Forbidden. Access to this resource on the server is denied!",
    "Your session has timed out. Please log in again.",
    "접근 권한이 없습니다. 로그인 후 이용해 주세요.",
    "장시간 사용하지 않아 자동으로 로그아웃되었습니다. 다시 로그인해 주세요.",
    "비정상적인 접근이 감지되어 차단되었습니다.",
    "현재 이용자가 많아 접속이 지연되고 있습니다. 잠시만 기다려 주십시오.",
    "We have received too many requests from your network. Please slow down.",
    "Please wait while we load the page...",
    "페이지를 불러오는 중입니다...",
]
FILLERS = [
    "Sed ut perspiciatis unde omnis iste natus error sit voluptatem accusantium doloremque laudantium.",
    "Curabitur pretium tincidunt lacus, nulla gravida orci a odio. Nullam varius turpis et commodo pharetra.",
    "Vivamus fermentum semper porta. Nunc diam velit adipiscing ut tristique vitae sagittis vel odio.",
    "Porvanti melura dosint karella ventis solum ardentis pirola monsi teluram.",
    "dummy text dummy text dummy text dummy text",
    "This is sample content. Replace it with your own text.",
    "Click here to edit this text.",
    "테스트 테스트 테스트 테스트",
    "임시 문구입니다. 나중에 교체 예정입니다.",
    "이곳에 본문을 작성해 주세요.",
    "예시 텍스트입니다. 실제 내용으로 바꿔 주세요.",
    "abc abc abc abc abc",
    "qwerty asdf zxcv",
    "ㅁㄴㅇㄹ ㅁㄴㅇㄹ ㅁㄴㅇㄹ",
    "페이지 준비 중입니다.",
    "Page under construction. Come back soon.",
    "TBD TBD TBD",
    "내용 없음",
]
FIELDS = [
    "안녕하세요, {{1}} 고객님께 안내 말씀을 드립니다.",
    "대출 한도는 <고객명>님의 신용도에 따라 정해집니다.",
    "만기일은 [만기일자]이며 자동으로 연장됩니다.",
    "Dear %CUSTOMER_NAME%, your deposit has matured.",
    "Your account $ACCOUNT_NO$ will be closed next week.",
    "{0}원을 {1} 계좌로 이체하였습니다.",
    "«이름» 고객님의 상담 신청이 접수되었습니다.",
    "Dear {{customer.profile.first_name_in_official_documents}}, welcome to our branch.",
    "The annual rate is ${product.rate.annual} for this term.",
    "Kính gửi {{ten_khach_hang}}, hợp đồng đã được gia hạn.",
    "가입 금액은 #{amount}원 이상이어야 합니다.",
    "담당 지점은 [[branch_name]]입니다.",
    "Please contact <%= manager.phone %> for details.",
    "이 상품의 금리는 [여기에 금리 입력]입니다.",
    "Contact us at [insert phone number here] for help.",
    "발급일: __ISSUE_DATE__ 발급 부서: __DEPT__",
    "{% if customer.vip %}우대 금리를 드립니다.{% endif %}",
    "Dear [Customer Name], thank you for choosing us.",
    "TODO: 담당자 연락처 기입",
    "고객번호 @@CUST_NO@@ 확인 바랍니다.",
]
ORDINARY = [
    "은행은 매월 말일에 이자를 계산하여 고객의 계좌에 넣어 드립니다.",
    "계약을 해지하려면 신분증을 지참하여 가까운 영업점을 방문하여야 합니다.",
    "The customer may withdraw the deposit before maturity with a reduced rate.",
    "Khách hàng có thể nộp hồ sơ tại quầy giao dịch trong giờ làm việc.",
]
EXPLAINING = [
    "404 오류는 주소가 잘못되었을 때 나타나며, 주소창을 다시 확인하면 해결됩니다.",
    "화면에 '세션이 만료되었습니다'라는 문구가 나오면 다시 로그인하면 됩니다.",
    "An HTTP 503 status means that the server cannot handle the request at the moment.",
    "If the page shows an error message, clear the cache and sign in again as described in section 2.",
    "인터넷뱅킹을 이용하려면 브라우저 설정에서 자바스크립트를 허용하는 방법을 먼저 읽어 보시기 바랍니다.",
    "JavaScript is a language that lets a page react to what the visitor does.",
    "정기 점검은 매월 셋째 일요일 새벽 2시부터 4시까지 이루어지며 그동안 이체를 할 수 없습니다.",
    "Scheduled maintenance takes place every second Sunday, and transfers are not processed during that time.",
    "서식의 {고객명} 자리에는 중괄호를 빼고 이름만 적습니다.",
    "In our templates the notation {{name}} stands for the name of the recipient.",
    "개발자 문서: 경로의 {id}는 자리 표시자로, 실제 번호로 바꾸어 호출합니다.",
    "The syntax ${amount} is replaced by the amount when the letter is printed.",
    "예:\n```\nHello {{ name }}\n```\n위 코드는 이름을 넣는 방법을 보여 줍니다.",
    "시험용 문구 'Lorem ipsum'은 인쇄물의 모양을 볼 때 쓰는 글이라는 설명을 직원이 덧붙였습니다.",
    "오류가 발생하면 콜센터로 연락하여 접수 번호를 받아 두는 것이 좋습니다.",
    "접근 권한은 지점장이 승인한 직원에게만 주며 분기마다 다시 확인합니다.",
    "비밀번호를 다섯 번 잘못 입력하면 계좌 이용이 차단되며 영업점에서만 풀 수 있습니다.",
    "Access to safe deposit boxes is permitted only during the opening hours of the branch.",
    "The session with the adviser lasts about an hour and is free of charge.",
    "서버 증설 작업은 내년 3월에 끝나며 그 뒤로는 접속 지연이 줄어들 것으로 보입니다.",
]
FORMS = [
    "성명: ____________  연락처: ____-____-____  서명: __________",
    "이율은 연 (      )%로 하며 고객이 직접 적습니다.",
    "신청일 20__년 __월 __일   신청인 (인)",
    "대출금액: 금 [            ]원정",
    "□ 동의함  □ 동의하지 않음",
]
MIXED = [
    "[표 1] 우대 금리 조건과 적용 기간을 아래에 적습니다.",
    "<개정 2023.04.01> 제3조의 기간을 30일로 합니다.",
    "[안내] 별빛 정기예금의 이율이 바뀌었습니다.",
    "할인율은 5%에서 10%로, 수수료는 $5에서 $3로 바뀝니다.",
    "자세한 사항은 [별지 제2호 서식]을 참고하시기 바랍니다.",
    "<표 3>에 따라 등급별 한도를 정합니다.",
    "문의는 help@bank.example 또는 1588-0000으로 하십시오.",
    "Rates rise from 3% to 5% on January 1, and fees fall from $20 to $10.",
]
TITLES = ["별빛 정기예금 상품설명서", "모은은행 | 개인 | 예금", "Home > Deposits > Notices", "[로고] 고객센터"]
FOOT = ["이전으로", "메인으로 돌아가기", "Go back", "문의번호 7f3a21"]


def cases() -> list[tuple[str, bool]]:
    out: list[tuple[str, bool]] = []
    for i, t in enumerate(PAGES + FILLERS):
        out += [(t, True), (f"{TITLES[i % 4]}\n{t}", True), (f"{t}\n\n{FOOT[i % 4]}", True)]
    for i, t in enumerate(FIELDS):
        a, b = ORDINARY[i % 4], ORDINARY[(i + 1) % 4]
        out += [(t, True), (f"{a}\n{t} {b}", True)]
    for i, t in enumerate(EXPLAINING):
        a, b = ORDINARY[i % 4], ORDINARY[(i + 1) % 4]
        out += [(t, False), (f"{a} {t}", False), (f"{TITLES[i % 4]}\n{t}\n{b}", False)]
    for i, t in enumerate(FORMS + MIXED):
        out += [(f"{ORDINARY[i % 4]}\n{t}", False), (f"{t} {ORDINARY[(i + 1) % 4]}", False)]
    for i, t in enumerate(PAGES):
        out += [(f"{t}\n{ORDINARY[i % 4]} {ORDINARY[(i + 1) % 4]} {ORDINARY[(i + 2) % 4]}", False)] if i % 2 else [(f"{ORDINARY[i % 4]} {ORDINARY[(i + 3) % 4]}\n{t}", False)]
    for i, a in enumerate(ORDINARY):
        out += [(f"{x}\n{a}", False) for x in TITLES] + [(f"{a}\n{x}", False) for x in FOOT] + [(f"{a} {b}", False) for b in ORDINARY]
    return out
