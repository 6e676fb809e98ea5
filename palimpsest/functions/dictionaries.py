"""Word lists for replacements and for recognising cities. Others can be registered or replaced at run time."""

from __future__ import annotations

# Given names and surnames of many countries, chosen by ourselves.
FIRST_NAMES = "Abena Adrian Aiko Alba Alfie Amara Anders Anika Arjun Astrid Basil Beatriz Bodil Bruno Callum Carmen Cedric Chiara Cyrus Dalia Darius Delphine Dmitri Edda Elio Elspeth Emeka Esme Farid Fiona Gideon Greta Hamish Helga Hugo Imani Ines Ingrid Ivo Jasper Jolene Kaito Keira Leif Linnea Lorcan Magda Marisol Mireille Nadia Nils Odette Orla Pavel Petra Quentin Rafael Rhea Rosalind Sanjay Signe Soren Tamsin Thabo Ulla Vera Viggo Wanda Xenia Yusuf Zelda".split()
LAST_NAMES = "Abernathy Achterberg Adeyemi Almeida Ashdown Baptiste Bergstrom Blackwood Borowski Calloway Castellano Chaudhary Corrigan Dahlgren Delacroix Drummond Eastwick Ekholm Fairbairn Ferreira Galbraith Gruber Hargreaves Holmquist Ibarra Jankovic Kaczmarek Kingsley Kowalczyk Lindqvist Lockhart Macallan Marchetti Mbeki Montague Nakamura Novak Okafor Ostrander Pemberton Petrov Quimby Rasmussen Rosewood Sandoval Silverstein Thackeray Thornbury Urbanek Vandermeer Villareal Wetherby Wojcik Yamamoto Zielinski".split()
# Cities by two public rules: the 50 state capitals by state, and the 50 most populous cities of the 2020 census by rank.
CAPITALS = "Montgomery,Juneau,Phoenix,Little Rock,Sacramento,Denver,Hartford,Dover,Tallahassee,Atlanta,Honolulu,Boise,Springfield,Indianapolis,Des Moines,Topeka,Frankfort,Baton Rouge,Augusta,Annapolis,Boston,Lansing,Saint Paul,Jackson,Jefferson City,Helena,Lincoln,Carson City,Concord,Trenton,Santa Fe,Albany,Raleigh,Bismarck,Columbus,Oklahoma City,Salem,Harrisburg,Providence,Columbia,Pierre,Nashville,Austin,Salt Lake City,Montpelier,Richmond,Olympia,Charleston,Madison,Cheyenne".split(",")
MOST_POPULOUS = "New York,Los Angeles,Chicago,Houston,Phoenix,Philadelphia,San Antonio,San Diego,Dallas,San Jose,Austin,Jacksonville,Fort Worth,Columbus,Indianapolis,Charlotte,San Francisco,Seattle,Denver,Washington,Nashville,Oklahoma City,El Paso,Boston,Portland,Las Vegas,Detroit,Memphis,Louisville,Baltimore,Milwaukee,Albuquerque,Tucson,Fresno,Sacramento,Kansas City,Mesa,Atlanta,Omaha,Colorado Springs,Raleigh,Long Beach,Virginia Beach,Miami,Oakland,Minneapolis,Tulsa,Bakersfield,Wichita,Arlington".split(",")
US_CITIES = list(dict.fromkeys(CAPITALS + MOST_POPULOUS))

_lists: dict[str, list[str]] = {"first_names": FIRST_NAMES, "last_names": LAST_NAMES, "us_cities": US_CITIES}


def get_dictionary(name: str) -> list[str]:
    """A named list; empty if there is none of that name."""
    return list(_lists.get(name, []))


def register_dictionary(name: str, values: list[str]) -> None:
    """Add or replace a list; blanks and repeats go, the order stays."""
    _lists[name] = list(dict.fromkeys(v.strip() for v in values if v and v.strip()))
