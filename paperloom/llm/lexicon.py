"""Parameters of the matcher: names of list entries that their spelling doesn't show, and remarks around values."""

from __future__ import annotations

# Names of entries of executive_documents.court.court_type that no rule derives from the entry.
COURTS = {
    "Районный суд общей юрисдикции": "федеральный районный суд; р/с",
    "Городской суд": "г/с",
    "Арбитражный суд субъекта": "арб. суд области (первая инстанция); арбитражный суд области; арбитражный суд",
    "Арбитражный суд округа": "окружной арбитраж",
    "Мировой судья": "судебный участок мирового судьи",
    "Третейский суд": "постоянно действующий третейский суд",
    "Областной (краевой) суд": "крайсуд",
    "Суд по интеллектуальным правам": "интеллектуальный суд",
}
# Names of entries of commercial_contracts.contract_type that no rule derives from the entry.
CONTRACTS = {
    "Договор купли-продажи": "дог. к/п",
    "Договор аренды нежилого помещения": "аренда офиса",
    "Договор субаренды": "поднаём помещения",
    "Договор аренды транспортного средства": "прокат авто; аренда автомобиля",
    "Договор подряда": "договор на выполнение работ",
    "Договор возмездного оказания услуг": "договор на услуги",
    "Договор займа": "заём",
    "Договор лизинга": "финансовая аренда; договор финансовой аренды",
    "Договор транспортной экспедиции": "ТЭО",
    "Договор перевозки груза": "грузоперевозка",
    "Агентский договор": "агентское соглашение; агентирование",
    "Договор уступки права требования": "договор цессии; цессия",
}
# Names of entries of enforcement_orders.court.doc_type that no rule derives from the entry.
DOCUMENTS = {
    "Судебный приказ": "приказ мирового судьи",
    "Постановление об административном правонарушении": "постановление по КоАП",
    "Определение суда": "судебное определение",
    "Постановление налогового органа": "пост. ИФНС",
}
# Names of entries of enforcement_orders.claimant.party_type that no rule derives from the entry.
SIDES = {
    "Физлицо": "ф/л; гр-н; гражданин; физическое лицо; частное лицо; гражданка; гр-ка",
    "Юрлицо": "ю/л; организация; коммерческая организация; юридическое лицо",
    "Индивидуальный предприниматель": "предприниматель без образования юр. лица; ИП (физлицо-предприниматель)",
    "Банк или кредитная организация": "МФО / банк; кред. орг.; коммерческий банк",
    "Налоговый орган": "ФНС; ИФНС; инспекция ФНС России; налог. инспекция",
    "Государственный орган": "гос. учреждение власти",
    "Орган местного самоуправления": "ОМСУ; мун. орган; муниципалитет; муниципальный орган; администрация муниципального образования",
    "Управляющая организация": "УК; УК ЖКХ",
    "Кооператив": "ЖСК; потребкооператив",
    "Иностранное лицо": "нерезидент; иностранная организация; иностр. компания",
    "Прокурор": "прокурор в защиту интересов; прок-ра района",
}
ALIASES = {
    "executive_documents.court.court_type": COURTS,
    "commercial_contracts.contract_type": CONTRACTS,
    "enforcement_orders.court.doc_type": DOCUMENTS,
    "enforcement_orders.claimant.party_type": SIDES,
}
# Remarks around a value; none names a kind of anything.
BEFORE = ("тип", "вид", "н", "наименование", "название")
AFTER = ("копия", "оригинал", "дубликат", "экз", "скан", "бн", "подлинник", "прил")
