"""Members, descriptions, routes, models and metadata of small sources, by rule and by the cases of the index's own tests."""

import pytest

from skein.operators import describe as D
from skein.operators import members as M
from skein.operators import models as O

CONTROLLER = """// --- BEGIN META
using Core.Validation;
namespace Shop.Rest
{
    /// <summary>
    /// Rest class for carts
    /// </summary>
    [ConfirmedUser]
    [AppBuilder]
    public class CartController : ShopBaseController
    {
        private readonly ICartManager _cartManager;

        public CartController(ICartManager mgr, UserManager<AppUser> users, IAdminLogger logger) : base(users, logger)
        {
            this._cartManager = mgr;
        }

        [HttpGet("/api/shop/cart/{id}")]
        public async Task<DetailResponse<Cart>> GetCart(string id)
        {
            var db = await _cartManager.GetCartAsync(id, Org, User);
            return DetailResponse<Cart>.Create(db);
        }

        [HttpGet("/api/shop/cart/factory")]
        public DetailResponse<Cart> CreateCart()
        {
            return DetailResponse<Cart>.Create();
        }

        [HttpGet("/api/shop/carts")]
        public Task<ListResponse<CartSummary>> GetCarts() => _cartManager.GetCartsForOrgAsync(Org, User, FromHeader());

        [HttpDelete("/api/shop/cart/{id}")]
        public Task<InvokeResult> DeleteCartAsync(string id)
        {
            return _cartManager.DeleteCartAsync(id, Org, User);
        }

        /// <summary>Adds one</summary>
        /// <remarks>With care</remarks>
        /// <param name="cart">What to add</param>
        [AllowAnonymous, HttpPost("/api/shop/cart")]
        public Task<InvokeResult> AddCart([FromBody] Cart cart, [FromHeader] string who = "me", [FromServices] IClock clock = null)
        {
            return _cartManager.AddCartAsync(cart, Org, User);
        }

        [HttpPut("/api/shop/cart")]
        public Task<InvokeResult> UpdateCart([FromBody] Cart cart, List<Line> lines) { Touch(cart); return _cartManager.UpdateCartAsync(cart, Org, User); }

        public void NoEndpoint() { }
    }
}
"""


@pytest.fixture(scope="module")
def read(spark):
    def types(*sources, path="src/F{}.cs"):
        return M.with_types(spark.createDataFrame([(path.format(i), s) for i, s in enumerate(sources)], "path string, text string"))

    return types


def test_endpoints_of_a_controller(read):
    rows = {r.action: r for r in D.endpoints(read(CONTROLLER)).collect()}
    assert list(rows) == ["GetCart", "CreateCart", "GetCarts", "DeleteCartAsync", "AddCart", "UpdateCart"]
    get, add, update, delete = (rows[n] for n in ("GetCart", "AddCart", "UpdateCart", "DeleteCartAsync"))
    assert (get.controller, get.endpoint_key, get.route, get.http_methods) == ("CartController", "CartController.GetCart", "/api/shop/cart/{id}", ["GET"])
    assert delete.endpoint_key == "CartController.DeleteCart"
    assert {r.primary_entity for r in rows.values()} == {"Cart", "CartSummary", "InvokeResult"}
    assert get.handler.asDict() == {"interface": "ICartManager", "method": "GetCartAsync", "kind": "Manager"} and rows["CreateCart"].handler is None
    assert rows["GetCarts"].handler.method == "GetCartsForOrgAsync"
    assert [(p.name, p.source, p.type, p.is_required) for p in get.parameters] == [("id", "Route", "String", True)]
    assert [p.name for p in add.parameters] == ["who"] and add.parameters[0].source == "Header" and add.parameters[0].default_value == '"me"' and not add.parameters[0].is_required
    assert add.request_body.model_type == update.request_body.model_type == "Cart" and add.request_body.description == "What to add"
    assert [(p.name, p.type, p.is_collection) for p in update.parameters] == [("lines", "List", True)]
    assert [(r.status, r.model_type, r.is_error) for r in get.responses] == [(200, "Cart", False), (400, None, True)]
    assert [r.status for r in add.responses] == [201, 400] and get.responses[0].wrapper_type == "DetailResponse<Cart>"
    assert (add.summary, add.description, get.summary) == ("Adds one", "With care", "GET Cart")
    assert get.authorization.asDict() == {"requires_authentication": True, "allow_anonymous": False, "tenancy": "OrgScoped"}
    assert add.authorization.asDict() == {"requires_authentication": False, "allow_anonymous": True, "tenancy": "Public"}
    assert [rows[n].ui_pattern for n in ("GetCart", "CreateCart", "GetCarts", "AddCart")] == ["FormLoad", "FormFactory", "List", None]
    assert (get.first_line, get.last_line) == (19, 24) and all(r.first_line <= r.last_line for r in rows.values())


def test_routes_by_class_method_and_constant(read):
    types = read(
        'namespace A { [Route(Names.Base)] public class XController { const string Own = "own"; [HttpGet(Own)] void A() {} [HttpPost("/abs")] Task B([FromBody] global::My.T<int> t) {} [HttpHead] void C(ListRequest r) {} [Get] void D() {} } }',
        'class Names { public const string Base = "api/v1/"; } [ApiController] class Y { [HttpPut("a//B/{id}?x=1")] void A(My.ListRequest<T> r) {} [Web.HttpPatchAttribute(Names.Missing)] void B([FromServices] I i) {} }',
        "class Z : Foo.ControllerBase { [HttpDelete, Route()] void A() {} }", "class NoRoutes { [HttpGet] void A() {} }",
    )
    rows = {f"{r.class_name}.{r.method_name}": r for r in D.controller_routes(types, D.constants(types)).collect()}
    assert {k: (r.verb, r.full_route, r.full_route_norm) for k, r in rows.items()} == {
        "XController.A": ("GET", "/api/v1/own", "/api/v1/own"), "XController.B": ("POST", "/abs", "/abs"), "XController.C": ("HEAD", "/api/v1/", "/api/v1"),
        "Y.A": ("PUT", "/a//B/{id}?x=1", "/a/b/{x}"), "Y.B": ("PATCH", "/Names.Missing", "/names.missing"), "Z.A": ("DELETE", "", ""),
    }
    assert (rows["XController.B"].body_type, rows["XController.B"].body_name, rows["XController.B"].has_body) == ("My.T<int>", "T", True)
    assert rows["XController.C"].takes_list_request and rows["Y.A"].takes_list_request and rows["Y.B"].takes_services and rows["XController.A"].full_name == "A.XController"
    raw = {f"{r.class_name}.{r.method_name}": r.full_route for r in D.controller_routes(types).collect()}
    assert raw["XController.A"] == "/Names.Base/Own"


MANAGER = """namespace Shop.Managers
{
    public class CartManager : ManagerBase, ICartManager
    {
        private readonly ICartRepo _repo;
        public CartManager(ICartRepo repo, ISecureStorage store, Clock clock, IDependencyManager d, ISecurity s) : base(d, s)
        {
            _repo = repo;
        }
        public async Task<InvokeResult> AddCartAsync(Cart cart, EntityHeader org) { ValidationCheck(cart); return await _repo.AddCartAsync(cart); }
        public Task DeleteCartAsync(string id) => _repo.DeleteCartAsync(id);
        private Task<Cart> GetCartAsync(string id) { return _repo.GetCartAsync(id); }
        private void UpdateCart(Cart c) { a(); b(); }
        protected bool Validate() { return true; }
        internal bool DoValidation(int? n, string[] all) { return true; }
    }
}
"""


def test_managers(read):
    (r,) = D.managers(read(MANAGER)).collect()
    assert (r.class_name, r.namespace, r.base_type, r.interfaces, r.primary_entity) == ("CartManager", "Shop.Managers", "ManagerBase", ["ICartManager"], "Cart")
    assert r.dependencies == ["ICartRepo", "ISecureStorage", "IDependencyManager", "ISecurity"]
    assert [p.type for p in r.constructors[0].parameters] == ["ICartRepo", "ISecureStorage", "Clock", "IDependencyManager", "ISecurity"] and "_repo = repo" in r.constructors[0].body
    assert {m.name: m.kind for m in r.methods} == {"AddCartAsync": "Create", "DeleteCartAsync": "Delete", "GetCartAsync": "Query", "UpdateCart": "Update", "Validate": "Validation", "DoValidation": "Validation"}
    assert [m.is_significant for m in r.methods] == [True, True, False, True, True, True] and r.methods[1].body == "=> _repo.DeleteCartAsync(id)"
    assert [p.type for p in r.methods[5].parameters] == ["Nullable", ""]
    names = [D.managers(read(s)).first().primary_entity for s in ("class Manager { void AddIt() {} void CreateOne(Box b, int n) {} }", "class Helper { void A(Box b) {} Crate B(Crate c) {} }", "class Empty { }")]
    assert names == ["Box", "Crate", None]


def test_repositories(read):
    rows = [D.repositories(read(s)).first() for s in (
        "namespace A { interface IKeep {} public class CartRepo : DocumentDBRepoBase<Data.Cart>, ICartRepo { public CartRepo(IKeep k, IOther o) {} public Task AddCartAsync(Cart c) {} Task GetCartSummariesForOrgAsync() {} Task GetCart() {} Task QueryKeys() {} Task UpsertX() {} Task RemoveX() {} } }",
        "class CartRepository : SqlThing { }", "class Store : InMemoryRepo { void SaveIt(Box b) {} }", "class Store { }",
    )]
    assert [r.primary_entity for r in rows] == ["Cart", "Cart", "Box", None] and [r.repository_kind for r in rows] == ["DocumentDb", "Sql", "InMemory", "Unknown"]
    assert [m.kind for m in rows[0].methods] == ["Insert", "Query", "GetById", "Query", "Update", "Delete"] and rows[0].dependencies == ["IKeep"] and rows[0].base_type == "DocumentDBRepoBase"


def test_interfaces(read):
    source = "namespace Shop { public interface ICartManager { Task<InvokeResult> AddAsync(Shop.Models.Cart cart, EntityHeader org); Task<Models.Cart> GetAsync(string id); Task<ListResponse<X>> AllAsync(ListRequest r = null); } }"
    (r,) = D.interfaces(read(source)).collect()
    assert (r.full_name, r.is_generic, r.generic_arity, r.base_interfaces, r.primary_entity, r.role) == ("Shop.ICartManager", False, 0, [], "Cart", "ManagerContract")
    assert [m.returns for m in r.methods] == ["Task<InvokeResult>", "Task<Models.Cart>", "Task<ListResponse<X>>"] and all(m.is_async for m in r.methods)
    assert [[p.type for p in m.parameters] for m in r.methods] == [["Cart", "EntityHeader"], ["String"], ["ListRequest"]] and r.methods[2].parameters[0].is_optional
    other = D.interfaces(read("interface IManager { Task<Box> A(Box b); int B(Lid l); } class Box {} class Lid {}", "interface IThing<T> : IA, IB<T> { }")).collect()
    assert [(x.primary_entity, x.role, x.generic_arity, x.base_interfaces) for x in other] == [("Box", "ManagerContract", 0, []), ("Thing", "OtherContract", 1, ["IA", "IB<T>"])]


MODEL = """namespace Shop.Models
{
    public enum Colors { Red }
    [EntityDescription(ShopDomain.Carts, R.Names.Cart_Title, R.Names.Cart_Description, "Cart_Help", Kinds.Simple, ListUIUrl: "/carts", SaveUrl: "/api/cart", CanImport: true)]
    public class Cart : EntityBase, IFormDescriptor
    {
        [FormField(LabelResource: R.Names.Common_Name, FieldType: FieldTypes.Text)] public string Name { get; set; }
        [FormField(LabelResource: R.Names.Owner, HelpResource: R.Names.Owner_Help, FieldType: FieldTypes.EntityHeaderPicker, EntityHeaderPickerUrl: "/api/owners")] public EntityHeader<Owner> Owner { get; set; }
        [FormField(FieldTypes.Picker, LabelResource: R.Names.Color)] public EntityHeader<Colors> Color { get; set; }
        [FormField(LabelResource: R.Names.Lines, FieldType: FieldTypes.ChildListInline)] public List<EntityHeader> Lines { get; set; }
        public int NoField { get; set; }
    }
}
"""
RESOURCES = [("b", "Cart_Title", "Cart"), ("a", "Cart_Title", " "), ("b", "Cart_Description", "A cart"), ("b", "Owner", "Who owns it"), ("b", "Owner_Help", "Help"), ("c", "Owner", "later")]


@pytest.fixture(scope="module")
def resources(spark):
    return spark.createDataFrame(RESOURCES, "resource_set string, key string, value string")


def test_model_structure(read, resources):
    (r,) = O.structures(read(MODEL), resources.where("value <> ' '")).collect()
    assert (r.qualified_name, r.domain, r.title, r.description, r.help, r.links.ListUIUrl, r.links.SaveUrl, r.links.GetUrl) == ("Shop.Models.Cart", "Carts", "Cart", "A cart", "Cart_Help", "/carts", "/api/cart", None)
    assert r.flags.asDict() == {"Cloneable": False, "CanImport": True, "CanExport": False}
    assert [(p.name, p.clr_type, p.is_collection, p.group) for p in r.properties] == [("Name", "string", False, None), ("Owner", "EntityHeader<Owner>", False, None), ("Color", "EntityHeader<Colors>", False, None), ("Lines", "EntityHeader", True, None), ("Key", "System.String", False, "EntityBase")]
    assert [(x.key, x.target) for x in r.header_refs] == [("owner", "Owner"), ("color", "Colors"), ("lines", None)]
    assert [(x.name, x.to_model, x.cardinality) for x in r.relationships] == [("CartToOwner", "Owner", "OneToOne"), ("CartToColors", "Colors", "OneToOne"), ("CartToEntityHeader", "EntityHeader", "OneToMany")]
    assert [x.key for x in r.children] == ["lines"] and r.properties[3].child_key == "lines"
    assert O.structures(read("[EntityDescription(A, B, C)] class X { }")).count() == 0


def test_header_fields_and_urls(read):
    types = read(MODEL, "enum Other { A }")
    fields = {r.property: r for r in D.header_fields(types).collect()}
    assert set(fields) == {"Owner", "Lines"}  # a reference to an enumeration is none
    assert (fields["Owner"].picker_url, fields["Owner"].field_type, fields["Owner"].argument_type, fields["Lines"].argument_is_enum) == ("/api/owners", "FieldTypes.EntityHeaderPicker", "Owner", False)
    (r,) = D.entity_urls(types).collect()
    assert (r.full_name, r.inherits_entity, r.inherits_summary, r.list_uiurl, r.save_url, r.get_url) == ("Shop.Models.Cart", True, False, "/carts", "/api/cart", None)


def test_metadata_lists_all_errors(read, resources):
    sources = [
        MODEL,
        "[EntityDescription(D.X, Cart_Title, Cart_Description, H)] class Fine { [FormField(LabelResource: R.Owner, HelpResource: Owner_Help)] public int A { get; set; } }",
        '[EntityDescription(D, "", R.None, H)] [My.EntityDescriptionAttribute(D)] class Bad { [FormField] public int A { get; set; } [FormField(LabelResource: "")] public int B { get; set; } [Other] public int C { get; set; } }',
        "[EntityDescription(D, T)] class Short { }", "class None { }",
    ]
    rows = {r.class_name: r for r in O.metadata(read(*sources), resources).collect()}
    assert set(rows) == {"Cart", "Fine", "Bad", "Short"} and rows["Fine"].errors == [] and rows["Fine"].title == "Cart" and rows["Fine"].domain_key == "X"
    assert rows["Fine"].fields[0].asDict() == {"property": "A", "label": "Who owns it", "help": "Help"}
    assert rows["Short"].errors == ["[EntityDescription] must have at least 4 positional arguments (domain, title, description, help)."]
    assert rows["Cart"].errors == [f"FormField on property '{p}' has LabelResource '{k}' that could not be resolved." for p, k in (("Name", "Common_Name"), ("Color", "Color"), ("Lines", "Lines"))]
    assert [f.label for f in rows["Cart"].fields] == ["Name", "Who owns it", "Color", "Lines"]
    assert rows["Bad"].errors == [
        "Class has multiple [EntityDescription] attributes.", "Title resource key could not be extracted from [EntityDescription].", "Description resource 'None' could not be resolved.",
        "FormField on property 'A' is missing a LabelResource argument.", "FormField on property 'B' has a LabelResource expression that could not be parsed.",
    ]


DOMAIN = """namespace Shop { [DomainDescriptor] public class ShopDomain {
  public const string Carts = "carts";
  [DomainDescription(Carts)] public static DomainDescription One { get { return new DomainDescription() { Name = "Carts; {", Description = "All", DomainType = DomainDescription.DomainTypes.Service }; } }
  [DomainDescription("lit")] public static DomainDescription Two { get { return Make(); } }
  [DomainDescription(Unknown)] public static DomainDescription Three => null;
  [DomainDescription(Carts)] public DomainDescription NotStatic { get; }
} }"""


def test_catalogue_first_domains_last_models(read, resources):
    again = DOMAIN.replace('"Carts; {"', '"Later"').replace('"carts"', '"CARTS"')
    types = read(DOMAIN, again, MODEL, MODEL.replace("namespace Shop.Models", "namespace shop.MODELS"))
    rows = sorted((r.entry, r.key, r.name, r.title, r.path, r.n) for r in O.catalogue(types, resources.where("value <> ' '")).collect())
    assert rows == [
        ("domain", "Three", "Three", "Three", "src/F0.cs", 2), ("domain", "carts", "One", "Carts; {", "src/F0.cs", 2), ("domain", "lit", "Two", "lit", "src/F0.cs", 2),
        ("domain_name", "Carts", "One", "Carts; {", "src/F0.cs", 2), ("domain_name", "Unknown", "Three", "Three", "src/F0.cs", 2), ("model", "shop.MODELS.Cart", "Cart", "Cart", "src/F3.cs", 2),
    ]
    one = {r.source_property: r for r in O.domains(types).where("path = 'src/F0.cs'").collect()}
    assert (one["One"].domain_type, one["One"].description, one["Two"].domain_type, one["One"].source_type) == ("Service", "All", "BusinessObject", "Shop.ShopDomain")


def test_entries_are_tested_below_the_reader(spark, resources, tmp_path):
    files = [("src/a.cs", MODEL), ("src/b.txt", MODEL), ("Tests\\c.cs", MODEL), ("src/d.cs", "class EntityDescription { }"), ("src/e.CS", MODEL.replace('"Cart_Help"', '""'))]
    spark.createDataFrame(files, "path string, text string").write.parquet(str(tmp_path / "f"))
    found = O.model_entries(spark.read.parquet(str(tmp_path / "f")), resources.where("value <> ' '"))
    assert [(r.path, r.model, r.title, r.help) for r in found.collect()] == [("src/a.cs", "Cart", "Cart", "Cart_Help")]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "StringContains(text,[EntityDescription)" in plan and plan.index("MapInArrow") < plan.index("StringContains(text")


def test_awkward_files(spark, read):
    assert M.with_types(spark.createDataFrame([(None, None), ("a", ""), ("b", " \n"), ("c", "no types here;")], "path string, text string")).count() == 0
    rows = read("class A { void B( { } class C<T { [X( int d", "class A { }", "class A { }", path="same").collect()
    assert [r.path for r in rows if r.name == "A"] == ["same"] * 3
    (r,) = read('class A { [X(@"a""b", "c\\u0041\\n\\"d", nameof(Y), 1 + 2, N = "e" + "f")] string q = @"x{;"; }').collect()
    assert [(a.name, a.text, a.value) for a in r.members[0].attributes[0].args] == [
        (None, '@"a""b"', 'a"b'), (None, '"c\\u0041\\n\\"d"', 'cA\n"d'), (None, "nameof(Y)", None), (None, "1 + 2", None), ("N", '"e" + "f"', None)]
    assert r.members[0].value == "x{;"


@pytest.mark.parametrize("filler", ["x", " ", "(", "[", "<", '"', "a.b ", "/*", "///\n", "{", "}", ",", "[A(", "int a;", "void A() { "])
def test_long_files_take_linear_time(filler):
    import time

    began = time.perf_counter()
    M.types_of("class A { int a; " + filler * (200_000 // len(filler)) + " }")
    assert time.perf_counter() - began < 6


def test_sections_fold_under_a_budget(spark, read):
    from pyspark.sql import functions as F

    from skein.functions.text import estimate_tokens
    from skein.operators import sections as S

    names = [f"{w}{i}" for i in range(30) for w in ("Get", "Add")]
    source = "class BoxManager : Base { " + " ".join(f"public Task {n}(Box b{i}) {{ }}" for i, n in enumerate(names)) + " }"
    described = D.managers(read(source, "class EmptyManager { }"))
    estimate = lambda t: spark.createDataFrame([(t,)], "t string").select(estimate_tokens("t")).first()[0]
    for budget in (1, 100, 300, 100_000):
        rows = S.manager_sections(described, budget=budget).where("section_key = 'manager-methods' AND symbol = 'BoxManager'").orderBy("part").collect()
        assert [r.part for r in rows] == list(range(1, len(rows) + 1)) and {r.total for r in rows} == {len(rows)}
        assert all(r.text.startswith("Methods for manager BoxManager:\n\n- Method ") for r in rows)
        found = [line.split()[2] for r in rows for line in r.text.split("\n") if line.startswith("- Method")]
        assert found == sorted(names)
        # by the rule: blocks join as long as header, blocks so far and the next one fit
        head, blocks = "Methods for manager BoxManager:\n", ["\n" + b + "\n" for r in rows for b in ("\n" + r.text).split("\n\n")[1:]]
        want, now = [], head
        for b in blocks:
            if estimate(now) + estimate(b) > budget and now != head:
                want.append(now)
                now = head
            now += b
        assert [r.text for r in rows] == [w.strip() for w in [*want, now]]
        if budget > 100_000 - 1:
            break
    empty = S.manager_sections(described).where("symbol = 'EmptyManager'").collect()
    assert {r.section_key: r.text.split("\n")[-1] for r in empty} == {"manager-overview": "Primary Entity: Empty", "manager-constructors": "No constructors discovered.", "manager-methods": "No methods discovered."}
    other = read("interface IBoxManager { Task<Box> Get(Box b); int Count(); }", "class BoxRepo : SqlThing, IBoxRepo { protected void SaveIt(Box b) { } }")
    assert [r.section_key for r in S.interface_sections(D.interfaces(other)).collect()] == ["interface-overview", "interface-methods"]
    texts = {r.section_key: r.text for r in S.repository_sections(D.repositories(other)).union(S.interface_sections(D.interfaces(other))).collect()}
    assert "Kind: Sql" in texts["repository-overview"] and "Kind: Insert, protected/internal, significant" in texts["repository-methods"]
    assert "- Method Get (InterfaceMethod) operates on the Box model. (async)\n  Returns: Task<Box>\n  Params: Box b" in texts["interface-methods"] and "IsGeneric: False, GenericArity: 0" in texts["interface-overview"]
    titled = F.struct(*[F.lit(x).cast("string").alias(n) for n, x in (("domain_name", None), ("domain_tagline", "Only this"), ("model_name", "Box"), ("model_class", "BoxModel"), ("model_tagline", "holds"))])
    first = S.repository_sections(D.repositories(other), titled).first().text
    assert first.startswith("Only this\nModel: Box — holds\n\nRepository: BoxRepo\n")


def test_method_sentences(spark):
    from pyspark.sql import functions as F

    from skein.operators.points import method_summary

    rows = [("Run", "Kind", "Box", "Shop", "void Run()", "focus", "model"), ("Run", None, " ", None, None, None, None), (None, None, None, None, None, None, None), ("Run", None, None, "Shop", "int Run().", None, "m")]
    got = spark.createDataFrame(rows, "a string, b string, c string, d string, e string, f string, g string").select(method_summary(*[F.col(c) for c in "abcdefg"])).collect()
    assert [r[0] for r in got] == [
        "Method Run (Kind) operates on the Box model in the Shop domain. Domain focus: focus. Model focus: model. Signature: void Run().", "Method Run.", "Method summary placeholder.", "Method Run in the Shop domain. Model focus: m. Signature: int Run().",
    ]


def test_chunks_of_methods_say_which():
    from skein.operators.symbols import symbol_chunks

    chunks = {(k, n): t for k, n, _, _, t in symbol_chunks("class A<T>\n{\n  [X(1)] public static async Task<T> Get<U>(int a,\n    string b = \"(\")\n  { }\n  public A(int x) : base(x) { }\n  int F;\n}")}
    assert chunks["method", "Get"].startswith('// Method Get. Signature: Task<T> Get(int a,\n    string b = "(").\n  [X(1)]') and chunks["method", "A"].startswith("// Method A. Signature: A(int x).\n")
    assert chunks["field", "F"] == "  int F;"
