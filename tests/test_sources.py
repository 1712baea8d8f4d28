"""Extraction from text, the file scan, the generator, settings and the command line."""

import json

import pytest

from depgraph import config as C
from depgraph.operators import validate
from depgraph.sources.files import scan
from depgraph.sources.php import graph_of, items
from depgraph.sources.synth import synthetic_graph

SERVICE = r"""<?php
namespace App\Svc;
use Lib\Logger;
use Lib\Thing as T;
/* class Fake { function x() { new Nope(); } } */
final class Service extends Base implements One, \Two {
    use Tr;
    const LIMIT = 5;
    private int $n = 0;
    public static ?Logger $log;
    public function __construct(private T $t) {}
    public function run(Logger $l): void {
        $x = new Logger(); // new Nope
        $y = "new Nope() {$x}";
        $z = <<<EOT
        new Nope() } {
        EOT;
        if ($x instanceof T) { $this->n = self::LIMIT; $this?->help(1); }
        try { Logger::make(); parent::run(); } catch (\Err | Oops $e) { strlen('a'); }
        $f = function () { return new \Abs\C(); };
        $o->m(); $o->p; T::$inst; new self(); new class { };
    }
    abstract protected function help($a);
}
interface One extends Zero { public function a(); }
enum Suit: string { case Hearts = 'h'; case Spades = 's'; }
function top() { switch (1) { case 2: return new Service(); } }
new Outside();
"""
NODES = """class Service|constant Service::LIMIT|property Service::n|property Service::log|method Service::__construct|property Service::t|method Service::run|method Service::help
interface One|method One::a|enum Suit|enum_case Suit::Hearts|enum_case Suit::Spades|function top"""
RUN = r"""instantiation Lib\Logger|instanceof Lib\Thing|property-access App\Svc\Service::n|const-fetch App\Svc\Service::LIMIT|method-call App\Svc\Service::help|static-call Lib\Logger::make
static-call App\Svc\Base::run|catch Err|catch App\Svc\Oops|function-call strlen|instantiation Abs\C|static-property-access Lib\Thing::inst|instantiation App\Svc\Service|declaration-type-parameter Lib\Logger"""
OTHER = r"""Service declaration-extends App\Svc\Base|Service declaration-implements App\Svc\One|Service declaration-implements Two|Service declaration-trait-use App\Svc\Tr|Service::log declaration-type-property Lib\Logger|Service::t declaration-type-property Lib\Thing|Service::__construct declaration-type-parameter Lib\Thing|One declaration-extends App\Svc\Zero|top instantiation App\Svc\Service"""


def split(text):
    return {x for line in text.split("\n") for x in line.split("|")}


@pytest.fixture(scope="module")
def extracted(spark):
    nodes, edges = items(spark.createDataFrame([("src/a.php", SERVICE), ("empty.php", ""), ("null.php", None), ("text.php", "no code: new Nope()")], "path string, content string"))
    return nodes.collect(), edges.collect()


def test_declarations(extracted):
    nodes, _ = extracted
    assert {f"{r.kind} {r.id.removeprefix('App' + chr(92) + 'Svc' + chr(92))}" for r in nodes} == split(NODES)
    line = {r.id: r.file.line for r in nodes}
    assert line["App\\Svc\\Service"] == 6 and line["App\\Svc\\Service::run"] == 12 and line["App\\Svc\\top"] == 27
    assert {r.file.name for r in nodes} == {"a.php"}


def test_uses(extracted):
    _, edges = extracted
    short = lambda x: x.removeprefix("App\\Svc\\")
    got = {(short(r.src), r.kind, r.dst) for r in edges}
    assert {f"{k} {d}" for s, k, d in got if s == "Service::run"} == split(RUN)
    rest = {f"{s} {k} {d}" for s, k, d in got if s != "Service::run" and k not in ("declaration-method", "declaration-property", "declaration-constant", "declaration-enum-case")}
    assert rest == split(OTHER)
    assert not any("Nope" in d or "Outside" in d for _, _, d in got)


PATTERNS = {
    "instantiation": ("new Dep()", "Dep"), "static-call": ("Dep::m()", "Dep::m"), "const-fetch": ("Dep::K", "Dep::K"), "instanceof": ("$a instanceof Dep", "Dep"), "function-call": ("dep()", "dep"),
    "method-call": ("$this->m()", "User::m"), "property-access": ("$this->p", "User::p"), "static-property-access": ("Dep::$p", "Dep::p"),
}
CONTEXTS = ("{};", "if ({}) {{ }}", "foreach ([1] as $i) {{ {}; }}", "try {{ {}; }} finally {{ }}", "$x = true ? {} : null;", "foo({});", "return {};", "$x = null ?? {};", "$f = fn() => {};", "$f = function () {{ {}; }};")


def test_usage_matrix(spark):
    """Each pattern in each context gives its edge, from the method that it stands in, exactly once."""
    rows, expected = [], set()
    for kind, (code, target) in PATTERNS.items():
        for i, context in enumerate(CONTEXTS):
            path = f"{kind}{i}"
            rows.append((path, f"<?php class User {{ function a() {{ {context.format(code)} }} function b() {{ $o->m(); $o->p; }} }}"))
            expected.add((path, "User::a", kind, target))
    _, edges = items(spark.createDataFrame(rows, "path string, content string"))
    got = [(r.file.path, r.src, r.kind, r.dst) for r in edges.where("kind NOT LIKE 'declaration%'").collect() if r.dst != "foo"]
    assert sorted(got) == sorted(expected)


LISTS = r"""<?php
namespace App;
use A\B, C\D as E;
use \G\{H, I\J as K, function f, const L,};
class X {
    const ONE = [1, 2], TWO = self::ONE, THREE = 3;
    public ?int $a, $b = [1, 2], $c;
    public function __construct(private int $p, $q) { echo $q, $p; new B(); new E(); new H(); new K(); new f(); }
}
"""


def test_lists_of_names(spark):
    """Each name of a use statement, a group, a list of constants and a list of properties counts."""
    nodes, edges = items(spark.createDataFrame([("a.php", LISTS)], "path string, content string"))
    got = {(r.id.split("::")[-1], r.kind) for r in nodes.where("kind IN ('constant', 'property')").collect()}
    assert got == {(x, "constant") for x in ("ONE", "TWO", "THREE")} | {(x, "property") for x in "abcp"}
    made = {r.dst for r in edges.where("kind = 'instantiation'").collect()}
    assert made == {"A\\B", "C\\D", "G\\H", "G\\I\\J", "App\\f"}


SIGNATURES = r"""<?php
namespace App;
use A\{T, U};
#[Mark, \Other(1, [T::K])] final class X {
    #[Mark(Y::class)]
    #[T] const ONE = 1, TWO = 2;
    #[U] public readonly ?T $a, $b;
    protected (T&U)|null|self $c = null;
    private int|string $n;
    static U $s;
    #[Run(new Z())] public function __construct(#[In] private T|U|null $p, #[U] protected (T&Q) $r, &...$rest) { static $kept = 1; $f = #[Lost(1)] fn(W $w): V => $w; }
    abstract function m(T $t = new Deep(), self $me, array $l = [U::K]): ?U;
    function n(): (T&U)|static { return fn(V $v): V => $v; }
}
enum E { #[Mark] case One; case Two; public function of(E $e): static { } }
#[T] function top(U &$u, string ...$s): \V|int { }
interface I { #[Mark] public function i(I $i): self; }
"""
SIGNED = r"""X attribute App\Mark|X attribute Other|X::ONE attribute App\Mark|X::ONE attribute A\T|X::TWO attribute App\Mark|X::TWO attribute A\T
X::a attribute A\U|X::b attribute A\U|X::a declaration-type-property A\T|X::b declaration-type-property A\T|X::c declaration-type-property A\T|X::c declaration-type-property A\U|X::s declaration-type-property A\U
X::__construct attribute App\Run|X::__construct attribute App\In|X::__construct attribute A\U|X::p attribute App\In|X::r attribute A\U
X::p declaration-type-property A\T|X::p declaration-type-property A\U|X::r declaration-type-property A\T|X::r declaration-type-property App\Q
X::__construct declaration-type-parameter A\T|X::__construct declaration-type-parameter A\U|X::__construct declaration-type-parameter App\Q
X::m declaration-type-parameter A\T|X::m declaration-type-return A\U|X::n declaration-type-return A\T|X::n declaration-type-return A\U
E::One attribute App\Mark|E::of declaration-type-parameter App\E|top attribute A\T|top declaration-type-parameter A\U|top declaration-type-return V|I::i attribute App\Mark|I::i declaration-type-parameter App\I"""


def test_types_and_attributes(spark):
    """Types of parameters, results and properties, however nested, and attributes of every declaration, each once;
    nothing in a head or an attribute is a use."""
    nodes, edges = items(spark.createDataFrame([("a.php", SIGNATURES)], "path string, content string"))
    rows = edges.where("kind = 'attribute' OR kind LIKE 'declaration-type%' OR kind NOT LIKE 'declaration%'").collect()
    got = [f"{r.src.removeprefix('App' + chr(92))} {r.kind} {r.dst}" for r in rows]
    twice = "X::__construct declaration-type-parameter A\\T"  # of two parameters
    assert sorted(got) == sorted([*split(SIGNED), twice])
    assert {r.id for r in nodes.where("kind = 'property'").collect()} == {f"App\\X::{x}" for x in ("a", "b", "c", "n", "s", "p", "r")}


def test_lexer_modes():
    """Strings and heredocs to any depth, HTML, unfinished texts, and the lines of tokens."""
    from depgraph.sources.lexer import lexed

    toks = lambda x: " ".join(t for t, _ in lexed(x))
    assert toks("<b>x</b>") == toks("") == toks("<?phpx y") == "" and toks("a <?= f() ?> b <?PHP g(); // h ?> i <?php") == "echo f ( ) ; g ( ) ; ;"
    deep = '"z"'
    for i in range(40):
        deep = f'"a{{$f({deep})}}b"'
    found = toks(f"<?php {deep};")
    assert found.count("$f") == 40 and found.endswith(") ;") and found.count("(") == found.count(")") == 80
    assert toks(r"""<?php "\\{$a} \$b {c} $d->e->f $g[1] ${h} $i?->j $ {" . 'k\'{$l}';""") == "'' . ( $a ) . ( $d -> e ) . ( $g ) . ( h ) . ( $i ?-> j ) . '' ;"
    assert toks('<?php "{$a->b(fn() => match(1) { 1 => "}", default => new class { } })} x" . y;') == "'' . ( $a -> b ( fn ( ) => match ( 1 ) { 1 => '' , default => new class { } } ) ) . y ;"
    heredoc = "<?php f(<<<A\n  $x A\n Ab {$y}\n\\\n  A, <<<'B'\n$no\nB, <<<\"C\"\nC);"
    assert toks(heredoc) == "f ( '' . ( $x ) . ( $y ) , '' , '' ) ;"
    assert toks("<?php # c\n#[A] /* ' */ 1.5 . 2..3; `ls $d`; __halt_compiler(); new X();") == "#[ A ] 1.5 . 2 . . 3 ; '' . ( $d ) ; __halt_compiler ;"
    for text in ('"', '"{$', "'", "<<<A\n", "<<<A\nA", "/*", '"$', '"${', "`", "<<<'A'\n"):
        toks("<?php " + text)
    assert [(t, n) for t, n in lexed("\n<?php a\n'x\ny' \"\n$b\" /*\n*/ c\n")] == [("a", 2), ("''", 3), ("''", 4), (".", 5), ("(", 5), ("$b", 5), (")", 5), ("c", 6)]


NAMES = r"""<?php
namespace App;
use Lib\{A, function f, function g as G2, const C};
use function Lib\h, Lib\i as j;
use const Lib\K;
use Lib\f\Deep as f;
class X {
    public $p { &get { return strlen($this->q); } final set($v) { other(); } }
    abstract public int $r { get; set; }
    function __construct(public $s { get => $this->t; }, private A $late) { get(); $x = ['set' => set(1)]; }
    function m() { F(); g2(); h(); J(); own(); OWN(); k(); A\z(); f\z(); namespace\z(); \z(); 1 & z(); new K(); new namespace\Y(); new f(); $c = function &() { }; $this->get(); }
}
function &own() { }
"""
CALLS = r"""X::m function-call Lib\f|X::m function-call Lib\g|X::m function-call Lib\h|X::m function-call Lib\i|X::m function-call App\own|X::m function-call k|X::m function-call Lib\A\z|X::m function-call Lib\f\Deep\z
X::m function-call App\z|X::m function-call z|X::m instantiation App\K|X::m instantiation App\Y|X::m instantiation Lib\f\Deep|X::m method-call App\X::get|X::$p::get function-call strlen|X::$p::get property-access App\X::q|X::$p::set function-call App\other
X::__construct function-call get|X::__construct function-call set|X::__construct property-access App\X::t"""


def test_names_and_hooks(spark):
    """Imports by kind, functions of the own namespace, and hooks as methods of their own."""
    files = [("a.php", NAMES), ("b.php", "<?php namespace App; function Other() { own(); } function z() { }"), ("c.php", "<?php namespace Else; function f() { own(); }")]
    nodes, edges = items(spark.createDataFrame(files, "path string, content string"))
    got = {f"{r.src.removeprefix('App' + chr(92))} {r.kind} {r.dst}" for r in edges.where("file.path = 'a.php' AND kind NOT LIKE 'declaration%'").collect()}
    assert got == {x.replace("App\\other", "App\\Other") for x in split(CALLS)}
    assert {r.id for r in nodes.where("kind = 'method' AND contains(id, '$')").collect()} == {f"App\\X::${p}::{h}" for p in "pr" for h in ("get", "set")}
    assert {(r.src, r.dst) for r in edges.where("file.path <> 'a.php'").collect()} == {("App\\Other", "App\\own"), ("Else\\f", "own")}


def test_anonymous_class(spark):
    """What an anonymous class does belongs to the method around it, which goes on after it; its methods aren't members."""
    code = "<?php class X { function f() { $o = new class { function g() { new In(); } }; new After(); } function h(T $t) { new Last(); } }"
    nodes, edges = items(spark.createDataFrame([("a.php", code)], "path string, content string"))
    assert {r.id for r in nodes.collect()} == {"X", "X::f", "X::h"}
    used = {(r.src, r.dst) for r in edges.where("kind <> 'declaration-method'").collect()}
    assert used == {("X::f", "In"), ("X::f", "After"), ("X::h", "T"), ("X::h", "Last")}


def test_order_of_edges(spark):
    """A declaration is followed by its attributes, then returned types, then parameters; files go by path."""
    code = r"<?php function {0}(#[B] D $d, E $e): R|Q {{ }} #[A] function z{0}(E $x): D {{ new K(); }}"
    _, edges = items(spark.createDataFrame([(f"{i}.php", code.format(f"f{i}")) for i in (3, 1, 2)], "path string, content string"))
    rows = edges.orderBy("seq").collect()
    assert [r.file.path for r in rows] == [f"{i}.php" for i in (1, 2, 3) for _ in range(9)]
    assert [r.dst for r in rows[:9]] == ["R", "Q", "B", "D", "E", "A", "D", "E", "K"]


def test_graph_of_text_holds(spark):
    graph = graph_of(spark.createDataFrame([("a.php", SERVICE)], "path string, content string"))
    for broken in (validate.one_way, validate.dangling, validate.repeated_nodes, validate.repeated_edges):
        assert broken(graph).count() == 0


def test_scan(spark, tmp_path):
    for name in ("a.php", "sub/b.php", "sub/bTest.php", "vendor/c.php", "d.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(f"<?php // {name}")
    found = lambda paths, **k: sorted(r.rel_path for r in scan(spark, [str(p) for p in paths], **k).collect())
    assert found([tmp_path]) == ["a.php", "sub/b.php", "sub/bTest.php", "vendor/c.php"]
    assert found([tmp_path], excludes=["vendor", "*Test.php"]) == ["a.php", "sub/b.php"]
    assert found([tmp_path], includes=["/^sub/"]) == ["sub/b.php", "sub/bTest.php"]
    assert found([tmp_path / "d.txt", tmp_path / "none"]) == ["d.txt"]
    assert found([tmp_path, tmp_path / "a.php"]) == found([tmp_path])
    assert found([]) == []


def test_excluded_folders_are_not_opened(spark, tmp_path, monkeypatch):
    """Only folders that may hold what counts are listed, each once; a pattern that is an expression prunes none."""
    from depgraph.sources import listing

    for name in ("a/b/x.php", "a/skip/deep/y.php", "a/skip/z.php", "c/d.php", "c/.git/e.php", "top.php", "c/n.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("<?php")
    log = tmp_path.parent / f"{tmp_path.name}.log"
    real = listing._list

    def counted(root):
        run = real(root)

        def logged(batches):
            def each():
                for b in batches:
                    with open(log, "a") as f:
                        f.writelines(f"{x}\n" for x in b.column(0).to_pylist())
                    yield b

            return run(each())

        return logged

    monkeypatch.setattr(listing, "_list", counted)
    found = lambda **o: sorted(r.rel_path for r in scan(spark, [str(tmp_path)], **o).collect())
    assert found(excludes=["skip"]) == ["a/b/x.php", "c/d.php", "top.php"]
    assert sorted(log.read_text().split("\n")) == ["", "", "a", "a/b", "c"]
    log.unlink()
    assert found(excludes=["/skip$/"], includes=["a/"]) == ["a/b/x.php", "a/skip/deep/y.php", "a/skip/z.php"]
    assert len(log.read_text().split("\n")) == 7
    assert not listing.reachable("nowhere://x/y")


def test_registry(spark, tmp_path, capsys):
    """A user's own analyser, collector and reporter, beside those that are here."""
    from pyspark.sql import functions as F

    from depgraph import cli, registry

    (tmp_path / "a.php").write_text("<?php namespace N; class A { function f(B $b) { echo 'x', print(1); $this->g(); } function g() { } }")
    try:

        @registry.COLLECTORS.register("echoes")
        def echoes(tokens):
            return tokens.where("lower(tok) = 'echo'").select("path", "pos", "line", F.col("source").alias("src"), F.lit("function-call").alias("kind"), F.lit("echo").alias("dst"))

        @registry.ANALYZERS.register("echoing")
        def echoing(spark, path):
            return registry.ANALYZERS.find("php")(spark, path, collectors=("echoes",))

        @registry.REPORTERS.register("flat")
        def flat(graph, root, direction="uses", level=None):
            return registry.REPORTERS.find("tree")(graph, root, direction, level).select("ord", F.col("id").alias("line"))

        assert cli.main(["--type", "echoing", "--format", "flat", "N\\A", str(tmp_path)], spark) == cli.OK
        assert capsys.readouterr().out.split() == ["N\\A", "N\\A::f", "N\\B", "echo", "N\\A::g", "N\\A::g"]
        assert cli.main(["--format", "dot", "--level", "1", "N\\A", str(tmp_path)], spark) == cli.OK
        out = capsys.readouterr().out.rstrip().split("\n")
        assert (out[0], out[-1]) == ("digraph {", "}") and sorted(out[1:-1]) == sorted(
            [r'  "N\\A" [tooltip="class"];', r'  "N\\A::f" [tooltip="method"];', r'  "N\\A::g" [tooltip="method"];', r'  "N\\A" -> "N\\A::f" [label="declaration-method"];', r'  "N\\A" -> "N\\A::g" [label="declaration-method"];']
        )
        assert cli.main(["--format", "none", "N\\A", str(tmp_path)], spark) == cli.FAILURE
        with pytest.raises(ValueError):
            registry.REPORTERS.register("flat")(flat)
        with pytest.raises(TypeError):
            registry.REPORTERS.register("text")("no function")
    finally:
        for r, name in ((registry.COLLECTORS, "echoes"), (registry.ANALYZERS, "echoing"), (registry.REPORTERS, "flat")):
            r.pop(name, None)


def test_synthetic(spark):
    seeds = spark.range(20).withColumnRenamed("id", "seed")
    graph = synthetic_graph(seeds, 3)
    for broken in (validate.one_way, validate.without_inverse, validate.dangling, validate.repeated_nodes, validate.repeated_edges, validate.mistyped, validate.asymmetric):
        assert broken(graph).count() == 0, broken.__name__
    rows = lambda g: sorted(map(str, g.nodes.collect() + g.edges.collect()))
    assert rows(graph) == rows(synthetic_graph(seeds, 3))
    assert synthetic_graph(seeds, 0).edges.count() == 0


@pytest.mark.parametrize(
    "change",
    [{"basePath": ""}, {"basePath": None}, {"direction": "up"}, {"level": 0}, {"level": "3"}, {"level": True}, {"includes": "x"}, {"excludes": [" "]}, {"type": "other"}, {"debug": 1}, {"type": "debug", "debug": {"depth": "5"}}, {"type": "debug", "debug": {"depth": 2, "seed": "1"}}],
)
def test_wrong_settings(change):
    with pytest.raises(C.ConfigError):
        C.merged(C.defaults(), change)


def test_layers(tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    env = {"DEPGRAPH_LEVEL": "4", "DEPGRAPH_EXCLUDES": "a, b", "DEPGRAPH_DIRECTION": "used-by", "DEPGRAPH_DEBUG_DEPTH": "5", "OTHER": "x"}
    assert C.from_env(env) == {"level": 4, "excludes": ["a", "b"], "direction": "used-by", "debug": {"depth": "5"}}
    config, target, _ = C.load(["-L", "2", "-E", "c", "A", "src"], env)
    assert (target, config.level, config.excludes, config.direction, config.base_path) == ("A", 2, ("c",), "used-by", "src")
    assert C.load(["-R", "-D", "uses", "A"], {})[0].direction == "used-by"
    assert C.load(["A", "--debug-seed", "3"], {})[0].debug == {"seed": 3}
    with pytest.raises(C.ConfigError, match="Invalid level: 0"):
        C.load(["-L", "0", "A"], {})
    assert C.from_yaml(str(tmp_path / "none.yaml")) == {}


def test_yaml(tmp_path):
    pytest.importorskip("yaml")
    path = tmp_path / "s.yaml"
    path.write_text(json.dumps({"level": 3}))
    assert C.from_yaml(str(path)) == {"level": 3}
    for text in ("- a", "a: ["):
        path.write_text(text)
        with pytest.raises(C.ConfigError):
            C.from_yaml(str(path))


def test_command_line(spark, tmp_path, capsys):
    from depgraph import cli

    (tmp_path / "a.php").write_text("<?php class A { function f() { new B(); } } class B { }")
    assert cli.main(["A", str(tmp_path)], spark) == cli.OK
    assert capsys.readouterr().out.split("\n")[:3] == ["A", "└── A::f", "    └── B"]
    assert cli.main(["-R", "B", str(tmp_path)], spark) == cli.OK
    assert capsys.readouterr().out.split("\n")[:3] == ["B", "└── A::f", "    └── A"]
    assert cli.main(["Nope", str(tmp_path)], spark) == cli.FAILURE
    assert cli.main(["-L", "x", "A"], spark) == cli.INVALID
    assert cli.main(["--type", "debug", "--debug-depth", "1", "--debug-seed", "1", "Nope"], spark) == cli.FAILURE


def test_tokens_stay_in_their_tasks(spark):
    """Only items are written, and tokens are neither shuffled nor sorted."""
    from depgraph.tables import recorded

    files = spark.createDataFrame([("a.php", SERVICE), ("b.php", LISTS)], "path string, content string")
    with recorded() as made:
        nodes, edges = items(files)
    assert max(t.count() for t in made) <= nodes.count() + edges.count()
    # where seq isn't asked for, paths aren't joined
    assert "Join" not in nodes.select("id").distinct()._jdf.queryExecution().optimizedPlan().toString()


def test_nodes_alone(spark):
    """Declarations come without edges, from one reading."""
    from depgraph.sources.php import declared_items
    from depgraph.tables import recorded

    files = spark.createDataFrame([("a.php", SERVICE), ("b.php", LISTS), ("n.php", None)], "path string, content string")
    with recorded() as made:
        nodes = declared_items(files)
    assert all(t.columns == ["path", "file_at"] for t in made)
    key = lambda df: sorted((r.id, r.kind, r.file.path, r.file.line) for r in df.collect())
    assert key(nodes) == key(items(files)[0])
