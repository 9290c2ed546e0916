"""The inline corpus: short snippets that exercise every detector, as a DataFrame and as SQL rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SNIPPETS: list[tuple[str, str]] = [
    ("python", 'uid = request.form.get("id")\nquery = "SELECT * FROM t WHERE id=" + uid\ncursor.execute(query)'),
    ("python", 'cursor.execute(f"DELETE FROM t WHERE id={x}")'),
    ("python", 'cursor.execute("SELECT 1 WHERE id=%s", (uid,))'),
    ("python", "import hashlib\nh = hashlib.md5(p)"),
    ("python", "import hashlib\netag = hashlib.md5(p)"),
    ("python", "random.seed(time.time())\ntoken = random.choice(xs)"),
    ("python", "random.shuffle(deck)  # game"),
    ("python", "data = pickle.loads(b)\ncfg = yaml.load(s, Loader=yaml.SafeLoader)"),
    ("python", 'resp.set_cookie("a", v,\n  secure=False)'),
    ("python", "if os.path.exists(p):\n    f = open(p)"),
    ("python", "f = open(p); ok = os.path.exists(p)"),
    ("python", 'name = request.args.get("n")\nsession["n"] = name'),
    ("python", "cipher = AES.new(k, AES.MODE_ECB)"),
    ("python", "key = RSA.generate(1024)\nother = RSA.generate(2048)"),
    ("python", "iv = b'0123456789abcdef'\nx = AES.new(k, AES.MODE_CBC, iv)"),
    ("python", "for k, v in d.items():\n    setattr(o, k, v)"),
    ("python", "libc = ctypes.CDLL(None)\nlibc.memcpy(a, b, n)\nctypes.byref(a)"),
    ("python", 'm = importlib.import_module(name)\nm = importlib.import_module("x")'),
    ("python", "def deep_merge(a, b):\n    for k, v in b.items():\n        a[k] = v"),
    ("python", "obj.__dict__.update(payload)"),
    ("python", "p = tempfile.mktemp()"),
    ("python", "x = input()\ny = x\nz = y + 'a'\nw = 1\neval(z)"),
    ("python", "b = a\na = input()\ncursor.execute(b)"),
    ("python", 'api_key = "sk-proj-AAAABBBBCCCCDDDDEEEEFFFFGGGGHHHH"\n# password = "not-in-a-comment"'),
    ("javascript", 'const key = "sk-proj-AAAABBBBCCCCDDDDEEEEFFFFGGGGHHHH";'),
    ("python", "blob = marshal.loads(raw)\nshelve.open(path)"),
    ("python", "key = hashlib.new('sha1')\nok = hashlib.sha256(x)"),
    ("python", "app.run(debug=True)"),
    ("python", "a = getattr(o, field)\nb = getattr(o, 'x')\nglobals()[name]"),
    ("python", "line one\r\nacc\u00e9nt\f\n"),
    ("python", 'bar = request.form.get("n")\nq = "/u[@n=" + bar + "]"\nroot.xpath(q)\nroot.xpath("/a")\n\n\n\n\nroot.xpath("/b")'),
    ("python", 'who = input()\nldap_filter = f"(uid={who})"\n# conn.search(base, who)\nconn.search(base, ldap_filter)'),
    ("java", 'who = input()\nconn.search(base, who)'),
    ("python", '# old = input()\nnew = old\ntree.xpath(new)'),
    ("python", 'r.set_cookie(\n  "a", f(\n  r.set_cookie("x")),\n  secure=False,\n)\nr.set_cookie("b", secure=True)\nr.set_cookie("c",\n  SECURE = false'),
    ("python", 'app = Flask(__name__)\n@app.route("/login", methods=["POST"])\ndef login():\n    return "ok"\n@app.route("/home")\ndef home():\n    return os.environ["HOME"]'),
    ("python", 'import csrf\n@bp.route("/upload", methods=["PUT"])\n@limiter.limit("5/min")\ndef put():\n    request.files["f"].save("/tmp/" + filename)\n\n\n\n\n\n\n\n    name = secure_filename(n)\n    f.save(filename)'),
    ("python", 'resp.headers["X-Frame-Options"] = "DENY"\n@app.route("/api")\ndef api():\n    if app.debug:\n        return sys.version'),
    ("python", 'name = request.args.get("n")\nsession["n"] = name\ng.user = "x"\ng.user = name'),
    ("python", 'prompt = f"System. User: {user_msg}" + user_msg\n# prompt = "x" + user\na = f"hello {user_name}"'),
    ("javascript", "// chat\nconst p = `llm says ${user_text}` + user"),
    ("python", "# agent tool\nos.remove(p)" + "\n" * 49 + "os.unlink(a)\nos.rmdir(b)\nfor_tool = 1\nsubprocess.Popen(x, shell=True)"),
    ("java", "agent.kill()"),
    ("python", 'def act(self, name, n: int = 3):\n    logger.info(f"hello {name}")\n    logger.info(name.replace("\\n", ""))\n    # logger.info(name)\n    out.write(name)'),
    ("python", 'who = request.args.get("w")\nline = who\nlogs = open("x")\nf.write(line)' + "\n" * 9 + "f.write(line)\nf.write(other)"),
    ("python", 'def do_GET(self):\n    q = parse_qs(self.path)\n    who = q.get("w")\n\n    self.wfile.write(who)\n    return f"plain {who}"\ndef other(q):\n    return f"<b>{q}</b>"'),
    ("python", 'def do_POST(self):\n    a = request.form["a"]\n    b = escape(a)\n    return f"<p>{a}"\n\n\n\n\n    return f"<p>{b}{a}"'),
    ("python", 'to = request.args["next"]\nreturn redirect(to)\n\n\n\n\n\n\n\n\n\nif urlparse(to).netloc: pass\nreturn redirect(to)\n\n\n\n\n\n\n\n\n\n\nredirect("/a")'),
    ("python", 'def grow(size, k=2):\n    a = "A" * size\n    b = [0] * int(size)\n\n\n\n\n    # c = "A" * size\n    if size < 10:\n        d = "A" * size\n\n\n\n\n\n\n    e = "A" * 3\n    f = bytearray(int(request.data))'),
    ("python", 't = input("t")\nt.format(x)\nrequest.args.get("f").format(1)\nu = t % (1,)\n"a".format(t)\nv = u % 3'),
    ("python", 'import xml.etree.ElementTree as tree\nfrom xml.sax import parseString as badParse\nimport defusedxml.ElementTree as goodET\ntree.fromstring(x)\nbadParse(x)\ngoodET.parse(x)\nminidom.parse(x)\np = XMLParser(resolve_entities=True)\n# ET.parse(x)\nx.tree.parse.go(y)'),
    ("python", "from defusedxml.sax import parseString\nimport xmlrpc\nfrom xml.dom.minidom import parseString as parseString\nparseString(x)\nlxml.parse(x, no_network=False); sax.parse(x)"),
    ("python", 'if ".." in path:\n    raise ValueError\nf = open(path)\nif p.find("..") != -1:\n    x = os.path.join(base, p)\n' + "\n" * 30 + 'if ".." in q:\n    q = unquote(q)\n    open(q)'),
    ("python", 'q = shlex.quote(arg)\nsubprocess.run(["a", q])\nos.system("ls " + q)\nsubprocess.run(q, shell=True)\nr = shlex.quote(arg)\nsubprocess.call(f"ls {r}", shell=True)'),
    ("python", "if verify(sig, data):\n    x = pickle.loads(data)\nelse:\n    y = yaml.load(data)\nif flag:\n    z = pickle.loads(data)"),
    ("python", "if hmac_ok:\n    (\n  x = pickle.loads(data)"),
    ("python", "agent = 1\ntools = [Tool(func=os.remove), Tool(func=subprocess.run)]\nTOOLS =\n[\n  run(shell=True),\n  sudo]\ntools = [safe]\nmy_tools = [os.remove, os.remove"),
    ("python", 'sql = "SELECT " + a' + "\n" * 11 + "db.execute(q)\ndb.execute(q)\nv = input()\n\nw = v\ncur.EXECUTEMANY( w )\ncur.execute(w, (v,))\n# cur.execute(w)\ncur.execute(other)\nstmt = f'SELECT {a}'"),
    ("python", 'config = {\n  "shell": True,\n  "other": {"n": 1}\nsettings = {\n  "filesystem": ["read",\n    "delete"]\n}\n"sudo": True\n"root": True, "run": True\npermissions = {\n  "admin": True'),
    ("javascript", 'a = input()\nb = request.json["b"]\nchat(b, a)\na = params["x"] + prompt\nllm = b\nprompts = a'),
    ("python", 'p = request.form.get("q")\nbar = p\nif 7 * 3 > 20:\n    bar = "ok"\nelse:\n    bar = p\n# a\n# b\n# c\n# d\n# e\nexec(bar)\nsession["u"] = bar\n\n\n\nredirect(p)'),
]


def code_files(spark: SparkSession) -> DataFrame:
    """file_id, path, language, code."""
    rows = [(k, f"src/c{k:02d}.{'py' if lang == 'python' else 'js'}", lang, code) for k, (lang, code) in enumerate(SNIPPETS, 1)]
    return spark.createDataFrame(rows, "file_id long, path string, language string, code string")


def code_files_sql() -> str:
    """The same rows as a SELECT."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ", ".join(f"({k}, {q(f'src/c{k:02d}.' + ('py' if lang == 'python' else 'js'))}, {q(lang)}, {q(code)})" for k, (lang, code) in enumerate(SNIPPETS, 1))
    return f"SELECT CAST(file_id AS BIGINT) AS file_id, path, language, code FROM (VALUES {rows}) AS v(file_id, path, language, code)"
