"""Words of Russian personal and corporate names, as parameters of the name parser."""

from __future__ import annotations

# First names with the stem of their patronymic (men), and short forms.
MEN = """Александр Александров саша шура саня; Алексей Алексеев лёша алёша леша; Анатолий Анатольев толя; Андрей Андреев андрюша;
Антон Антонов антоша; Артём Артёмов тёма; Борис Борисов боря; Вадим Вадимов вадик; Валентин Валентинов валя; Валерий Валерьев валера;
Василий Васильев вася; Виктор Викторов витя; Виталий Витальев виталик; Владимир Владимиров вова володя; Вячеслав Вячеславов слава;
Геннадий Геннадьев гена; Георгий Георгиев гоша жора; Григорий Григорьев гриша; Денис Денисов дениска; Дмитрий Дмитриев дима митя;
Евгений Евгеньев женя; Егор Егоров егорка; Иван Иванов ваня; Игорь Игорев игорёк; Илья Ильи илюша; Кирилл Кириллов кирюша;
Константин Константинов костя; Леонид Леонидов лёня; Максим Максимов макс; Марк Марков марик; Михаил Михайлов миша; Никита Никитов никитка;
Николай Николаев коля; Олег Олегов олежка; Павел Павлов паша; Пётр Петров петя; Роман Романов рома; Руслан Русланов русик;
Семён Семёнов сеня; Сергей Сергеев серёжа; Станислав Станиславов стас; Степан Степанов стёпа; Тимофей Тимофеев тима; Фёдор Фёдоров федя;
Эдуард Эдуардов эдик; Юрий Юрьев юра; Яков Яковлев яша; Ярослав Ярославов ярик"""
# First names of women with short forms.
WOMEN = """Александра саша шура; Алина аля; Алла аллочка; Анастасия настя; Анна аня нюра; Валентина валя; Валерия лера; Варвара варя; Вера верочка;
Вероника ника; Виктория вика; Галина галя; Дарья даша; Диана диночка; Евгения женя; Екатерина катя; Елена лена; Елизавета лиза;
Жанна жанночка; Зинаида зина; Зоя зоечка; Инна инночка; Ирина ира; Кира кирочка; Ксения ксюша; Лариса лара; Лидия лида; Любовь люба; Людмила люда мила;
Маргарита рита; Марина мариша; Мария маша маруся; Надежда надя; Наталья наташа; Нина ниночка; Оксана ксана; Ольга оля; Полина поля;
Раиса рая; Светлана света; София соня; Тамара тома; Татьяна таня; Юлия юля; Яна яночка"""
# Words that are a post, a remark or a branch.
POSTS = set("""судебный судебного судебному пристав пристава приставу исполнитель исполнителя исп спи суд ведущий зам нач отдела начальник старший заместитель врио
гр гражданин гражданка гражданина представитель дов доверенности инн не указан доп офис филиал отделение фирма firma branch взыскатель должник""".split())
# Short names of legal forms, by their Russian one.
FORMS = {"пао": "пао pao pjsc оао oao", "ао": "ао ao jsc", "зао": "зао zao", "ооо": "ооо ooo llc", "тсж": "тсж tszh tsl", "муп": "муп mup", "гуп": "гуп gup", "пк": "пк pk", "жск": "жск", "ип": "ип", "ltd": "ltd", "gmbh": "gmbh", "ag": "ag", "sro": "sro"}
# The words of legal forms in full; a form is known by the first letters of its words.
LONG_FORMS = {"пао": "публичное акционерное общество", "ао": "акционерное общество", "ооо": "общество с ограниченной ответственностью", "муп": "муниципальное унитарное предприятие", "тсж": "товарищество собственников жилья", "пк": "потребительский кооператив"}
FORM_WORDS = {
    "публичное": "публичное публичным публичного публичному публичное", "акционерное": "акц акционерное акционерным акционерного акционерному",
    "общество": "общество обществом общества обществу", "ограниченной": "ограниченной", "ответственностью": "ответственностью",
    "муниципальное": "муниципальное муниципальным муниципального", "унитарное": "унитарное унитарным унитарного", "предприятие": "предприятие предприятием предприятия",
    "товарищество": "товарищество товариществом товарищества", "собственников": "собственников", "жилья": "жилья",
    "потребительский": "потребительский потребительским потребительского", "кооператив": "кооператив кооперативом кооператива",
}
# Second words of company names.
SECOND = "агро инвест логистик медиа сервис строй торг энерго"
