"""JSON-LD of a page: blocks, nodes, types, references and what the factors ask of them."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Any

from weftline.functions.urls import parse_url

# Schema.org's LocalBusiness and its subtypes.
LOCAL_BUSINESS = frozenset(
    """
    LocalBusiness AnimalShelter ArchiveOrganization ChildCare DryCleaningOrLaundry EmploymentAgency InternetCafe Library
    ProfessionalService RadioStation RealEstateAgent RecyclingCenter SelfStorage ShoppingCenter TelevisionStation
    TouristInformationCenter TravelAgency AutomotiveBusiness AutoBodyShop AutoDealer AutoPartsStore AutoRental AutoRepair
    AutoWash GasStation MotorcycleDealer MotorcycleRepair EmergencyService FireStation Hospital PoliceStation
    EntertainmentBusiness AdultEntertainment AmusementPark ArtGallery Casino ComedyClub MovieTheater NightClub
    FinancialService AccountingService AutomatedTeller BankOrCreditUnion InsuranceAgency FoodEstablishment Bakery BarOrPub
    Brewery CafeOrCoffeeShop Distillery FastFoodRestaurant IceCreamShop Restaurant Winery GovernmentOffice PostOffice
    HealthAndBeautyBusiness BeautySalon DaySpa HairSalon HealthClub NailSalon TattooParlor HomeAndConstructionBusiness
    Electrician GeneralContractor HVACBusiness HousePainter Locksmith MovingCompany Plumber RoofingContractor LegalService
    Attorney Notary LodgingBusiness BedAndBreakfast Campground Hostel Hotel Motel Resort SkiResort VacationRental
    MedicalBusiness CommunityHealth Dentist Dermatology DietNutrition Emergency Geriatric Gynecologic MedicalClinic
    CovidTestingFacility Midwifery Nursing Obstetric Oncologic Optician Optometric Otolaryngologic Pediatric Pharmacy
    Physician IndividualPhysician PhysiciansOffice Physiotherapy PlasticSurgery Podiatric PrimaryCare Psychiatric
    PublicHealth SportsActivityLocation BowlingAlley ExerciseGym GolfCourse PublicSwimmingPool SportsClub StadiumOrArena
    TennisComplex Store BikeStore BookStore ClothingStore ComputerStore ConvenienceStore DepartmentStore ElectronicsStore
    Florist FurnitureStore GardenStore GroceryStore HardwareStore HobbyShop HomeGoodsStore JewelryStore LiquorStore
    MensClothingStore MobilePhoneStore MovieRentalStore MusicStore OfficeEquipmentStore OutletStore PawnShop PetStore
    ShoeStore SportingGoodsStore TireShop ToyStore WholesaleStore
    """.split()
)
BUSINESS_PROPERTIES = ("name", "address", "telephone", "openingHours", "priceRange", "image", "url", "geo")
ORGANISATION_PROPERTIES = ("name", "logo", "contactPoint", "sameAs", "foundingDate", "url", "description")


def as_list(x: Any) -> list:
    return x if isinstance(x, list) else [] if x in (None, "", False, 0) else [x]


def types_of(node: Any) -> list[str]:
    got = node.get("@type") if isinstance(node, dict) else None
    return [t for t in (got if isinstance(got, list) else [got]) if isinstance(t, str)]


def bare(kind: str) -> str:
    return re.sub(r"^(https?://schema\.org/|schema:)", "", kind.strip(), flags=re.IGNORECASE)


def load_blocks(raw: list[str]) -> list[dict]:
    """One record a block: idx, empty, error, types (of the nodes at its top) and the parsed value."""
    out = []
    for i, text in enumerate(raw):
        block: dict = {"idx": i, "empty": not text.strip(), "error": None, "types": [], "value": None}
        if not block["empty"]:
            try:
                block["value"] = json.loads(text)
                block["types"] = [t.strip() for n in tops(block["value"]) for t in types_of(n) if t.strip()]
            except (ValueError, RecursionError) as e:
                block["error"] = str(e)
        out.append(block)
    return out


def tops(value: Any) -> Iterator[dict]:
    """Nodes at the top: members of lists, and of @graph in place of what holds it."""
    if isinstance(value, list):
        for x in value:
            yield from tops(x)
    elif isinstance(value, dict):
        if value.get("@graph"):
            yield from tops(value["@graph"])
        else:
            yield value


def flatten(value: Any) -> Iterator[dict]:
    """Nodes at the top and the holders of @graph, those after their members."""
    if isinstance(value, list):
        for x in value:
            yield from flatten(x)
    elif isinstance(value, dict):
        if value.get("@graph"):
            yield from flatten(value["@graph"])
        yield value


def nested(value: Any) -> Iterator[dict]:
    """Every object at any depth, outer ones first, each once."""
    stack, seen = [value], set()
    while stack:
        x = stack.pop()
        if isinstance(x, (dict, list)):
            if id(x) in seen:
                continue
            seen.add(id(x))
            if isinstance(x, dict):
                yield x
                stack += reversed(list(x.values()))
            else:
                stack += reversed(x)


def is_reference(node: Any) -> bool:
    """Whether a node only names another: nothing but its @id, and perhaps its @type."""
    return isinstance(node, dict) and isinstance(node.get("@id"), str) and node.keys() <= {"@id", "@type"}


class Nodes:
    """All nodes of a page, with lookups."""

    def __init__(self, blocks: list[dict], page_url: str):
        self.flat = [n for b in blocks if b["value"] is not None for n in flatten(b["value"])]
        self.every = list(nested([b["value"] for b in blocks if b["value"] is not None]))
        self.base = parse_url(page_url)
        self.named: dict[str, dict] = {}
        for n in self.every:
            if isinstance(n.get("@id"), str) and not is_reference(n) and (key := self._id(n["@id"])):
                self.named.setdefault(key, n)

    def _id(self, text: str) -> str | None:
        if not text or text.startswith("_:"):
            return None
        url = parse_url(text, self.base)
        return url.text() if url else text

    def resolve(self, node: Any) -> Any:
        return self.named.get(self._id(node["@id"]) or "", node) if is_reference(node) else node

    def types(self) -> list[str]:
        return sorted({t for n in self.every for t in types_of(n) if t})

    def of_type(self, kind: str) -> list[dict]:
        return [n for n in self.every if kind in types_of(n)]

    def top_of_type(self, kind: str) -> list[dict]:
        return [n for n in self.flat if kind in types_of(n)]

    def businesses(self) -> list[tuple[dict, str]]:
        """LocalBusiness-family nodes that the page declares: at the top, or as mainEntity or about of one."""
        out, seen = [], set()
        for n in self.flat:
            for x in [n, *as_list(n.get("mainEntity")), *as_list(n.get("about"))]:
                kind = next((bare(t) for t in types_of(x) if bare(t) in LOCAL_BUSINESS), None) if isinstance(x, dict) else None
                if kind and id(x) not in seen:
                    seen.add(id(x))
                    out.append((x, kind))
        return out


def share(node: dict, properties: tuple[str, ...]) -> float:
    return sum(node.get(p) not in (None, "") for p in properties) / len(properties)


def completeness(nodes: Nodes) -> tuple[float | None, list[str]]:
    """Points of the schema-completeness factor, None without JSON-LD, and its findings as "type code". FAQ and how-to nodes add points each but count as one check."""
    if not nodes.flat:
        return None, ["missing schema.none"]
    found: list[str] = []

    def grade(about: str, *steps: tuple[bool, float, str]) -> float:
        worth, kind = next((worth, kind) for held, worth, kind in steps if held)
        found.append(f"{kind.split(' ')[0]} {about}.{kind.split(' ')[1]}")
        return worth

    checks, points = 0, 0.0
    seen: dict[int, dict] = {}
    for n in [*nodes.of_type("LocalBusiness"), *nodes.of_type("ProfessionalService"), *[x for n, _ in nodes.businesses() if not is_reference(x := nodes.resolve(n))]]:
        seen.setdefault(id(n), n)
    if seen:
        checks, best = checks + 1, max(share(n, BUSINESS_PROPERTIES) for n in seen.values())
        points += grade("local-business", (best >= 0.75, 100, "found strong"), (best >= 0.5, 60, "info partial"), (True, 25, "missing low"))
    if faqs := nodes.of_type("FAQPage"):
        checks += 1
        for faq in faqs:
            asked = [q for x in as_list(faq.get("mainEntity")) if "Question" in types_of(q := nodes.resolve(x))]
            answers = [nodes.resolve(q.get("acceptedAnswer")) for q in asked]
            long = sum(isinstance(a, dict) and isinstance(a.get("text"), str) and len(re.split(r"\s+", a["text"])) >= 15 for a in answers)
            points += grade("faqpage", (long >= 3, 100, "found strong"), (len(asked) >= 3, 65, "info partial"), (True, 35, "info low"))
    if guides := nodes.of_type("HowTo"):
        checks += 1
        for guide in guides:
            steps = [s for x in as_list(guide.get("step")) if isinstance(s := nodes.resolve(x), dict) and (s.get("name") or s.get("text"))]
            points += grade("howto", (len(steps) >= 3, 100, "found strong"), (True, 40, "info partial"))
    if orgs := nodes.of_type("Organization"):
        checks, best = checks + 1, max(share(n, ORGANISATION_PROPERTIES) for n in orgs)
        points += grade("organization", (best >= 0.7, 100, "found strong"), (best >= 0.4, 55, "info partial"), (True, 20, "missing low"))
    if checks:
        return points / checks, found
    deep = sum(map(len, nodes.flat)) / len(nodes.flat) >= 8
    return grade("schema-depth", (deep, 70.0, "info moderate"), (True, 30.0, "info low")), found


def facts(nodes: Nodes) -> dict:
    """What the factors read from a page's nodes."""
    flat = nodes.flat
    people = [p for n in flat if "Person" in types_of(n) for p in [n]]
    for n in flat:
        people += [c for k in ("author", "creator", "contributor") for c in as_list(n.get(k)) if isinstance(c, dict) and "Person" in types_of(c)]
    orgs = {id(n): n for k in ("Organization", "LocalBusiness", "ProfessionalService") for n in nodes.top_of_type(k)} | {id(n): n for n, _ in nodes.businesses()}
    points = [c for n in flat for c in [n, *[p for p in as_list(n.get("contactPoint")) if isinstance(p, dict)]]]
    size = lambda x: len(x) if isinstance(x, list) else 0
    complete, graded = completeness(nodes)
    return {
        "n_nodes": len(flat), "n_props": sum(map(len, flat)), "types": nodes.types(), "business_types": [k for _, k in nodes.businesses()],
        "names": [n["name"] for n in flat if isinstance(n.get("name"), str)],
        "same_as": sum(size(n.get("sameAs")) if isinstance(n.get("sameAs"), list) else isinstance(n.get("sameAs"), str) for n in flat),
        "knows_about": sum(size(n.get("knowsAbout")) for n in flat),
        "founders": sum(size(n["founder"]) if isinstance(n.get("founder"), list) else bool(n.get("founder")) for n in flat),
        "persons": [any(p.get(k) for k in ("jobTitle", "alumniOf", "hasCredential")) for p in people],
        "orgs": [bool(o.get("founder") or o.get("employee")) for o in orgs.values()],
        "emails": [c["email"] for c in points if isinstance(c.get("email"), str)], "phones": [c["telephone"] for c in points if isinstance(c.get("telephone"), str)],
        "modified": [n["dateModified"] for n in flat if isinstance(n.get("dateModified"), str)],
        "has_geo": any(isinstance(n.get("geo"), (dict, list)) and bool(n["geo"] or n["geo"] == []) for n in flat),
        "has_address": any(isinstance(n.get("address"), (dict, list)) for n in flat), "has_area": any(bool(n.get("areaServed")) for n in flat),
        "actions": sum(any(t.endswith("Action") for t in types_of(n)) for n in nodes.every),
        "actions_ready": sum(any(t.endswith("Action") for t in types_of(n)) and "target" in n and any(k in n for k in ("query-input", "object", "result")) for n in nodes.every), "completeness": complete, "completeness_found": graded,
    }
