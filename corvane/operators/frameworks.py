"""What a symbol's text tells of the framework it is written for."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: By language the answers in order, each with the texts that give it: any one of a list, `` & `` joins texts that must all stand. An answer without texts is the language's own.
FRAMEWORKS: dict[str, list[tuple[str, list[str]]]] = {
    "phoenix": [
        ("using Phoenix LiveView", ["use Phoenix.LiveView"]),
        ("using Phoenix LiveComponent", ["use Phoenix.LiveComponent"]),
        ("using Phoenix Controller", ["use Phoenix.Controller"]),
        ("using Phoenix Router", ["use Phoenix.Router"]),
        ("using Phoenix Channel (WebSocket)", ["use Phoenix.Channel"]),
        ("using Phoenix with Ecto schema", ["schema  & use Ecto"]),
        ("using Phoenix Framework", []),
    ],
    "elixir": [
        ("using Ecto schema (database layer)", ["use Ecto.Schema"]),
        ("implementing a GenServer OTP process", ["use GenServer"]),
        ("implementing an OTP Supervisor", ["use Supervisor"]),
        ("implementing an OTP Agent", ["use Agent"]),
        ("using OTP Task for async work", ["use Task"]),
        ("using Broadway for message processing pipelines", ["use Broadway"]),
        ("using Oban for background job processing", ["use Oban"]),
        ("using Absinthe GraphQL", ["use Absinthe"]),
        ("in Elixir/OTP", []),
    ],
    "typescript": [
        ("using Angular (component)", ["@Component & selector"]),
        ("using Angular/NestJS dependency injection", ["@Injectable"]),
        ("using NestJS REST controller", ["@Controller", "@Get("]),
        ("using React (functional component with hooks)", ["useState", "useEffect"]),
        ("using React (class component)", ["React.Component"]),
        ("using Vue 3 Composition API", ["defineComponent", "ref("]),
        ("using Vue 2", ["Vue.component"]),
        ("using Redux Toolkit", ["createSlice", "createReducer"]),
        ("using Express.js", ["express()", "app.get("]),
        ("using Fastify", ["fastify"]),
        ("using Prisma ORM", ["prisma"]),
        ("using Drizzle ORM", ["drizzle"]),
        ("using Next.js", ["next/"]),
        ("using Nuxt.js", ["nuxt"]),
        ("in TypeScript/Node.js", []),
    ],
    "django": [
        ("using Django ORM model", ["models.Model"]),
        ("using Django REST Framework", ["APIView", "ViewSet"]),
        ("using Django class-based view", ["TemplateView", "ListView"]),
        ("using Django admin", ["admin.ModelAdmin"]),
        ("using Django", []),
    ],
    "python": [
        ("using Flask web framework", ["@app.route", "Flask"]),
        ("using FastAPI (async REST)", ["@router.", "FastAPI"]),
        ("django", ["from django", "Django"]),
        ("using SQLAlchemy ORM", ["sqlalchemy", "SQLAlchemy"]),
        ("using Pydantic for data validation", ["pydantic"]),
        ("using Celery for async tasks", ["celery"]),
        ("in a pytest test module", ["pytest"]),
        ("in a machine learning module", ["torch", "tensorflow"]),
        ("in Python", []),
    ],
    "ruby": [
        ("using Ruby on Rails (controller)", ["< ApplicationController"]),
        ("using Rails ActiveRecord model", ["< ActiveRecord::Base", "< ApplicationRecord"]),
        ("using Devise for authentication", ["include Devise"]),
        ("using Sidekiq for background jobs", ["Sidekiq"]),
        ("in Ruby", []),
    ],
    "php": [
        ("using Laravel controller", ["extends Controller"]),
        ("using Laravel Eloquent ORM", ["extends Model", "Eloquent"]),
        ("in a Laravel routes file", ["Route::"]),
        ("using Symfony controller", ["extends AbstractController"]),
        ("using Symfony routing attributes", ["#[Route("]),
        ("in PHP", []),
    ],
    "java": [
        ("using Spring MVC/Boot controller", ["@RestController", "@Controller"]),
        ("using Spring Service component", ["@Service"]),
        ("using Spring Data repository", ["@Repository"]),
        ("using JPA entity (Hibernate)", ["@Entity"]),
        ("Spring Boot application entry point", ["@SpringBootApplication"]),
        ("using Android Activity", ["extends Activity"]),
        ("using Android Fragment", ["extends Fragment"]),
        ("in Java", []),
    ],
    "kotlin": [
        ("using Jetpack Compose UI", ["@Composable"]),
        ("using Android ViewModel (MVVM)", ["ViewModel()"]),
        ("using Kotlin coroutines", ["suspend fun"]),
        ("using Spring Boot (Kotlin)", ["@RestController"]),
        ("using Android Fragment", ["Fragment()"]),
        ("in Kotlin", []),
    ],
    "dart": [
        ("using Flutter StatelessWidget", ["extends StatelessWidget"]),
        ("using Flutter StatefulWidget", ["extends StatefulWidget", "extends State<"]),
        ("using Flutter Provider/ChangeNotifier", ["ChangeNotifier"]),
        ("using Flutter BLoC/Cubit state management", ["BlocBase", "Cubit"]),
        ("using Flutter Riverpod state management", ["Riverpod", "ref.watch"]),
        ("using Flutter GetX", ["GetX"]),
        ("in Dart/Flutter", []),
    ],
    "swift": [
        ("using SwiftUI View", ["struct & View {"]),
        ("using SwiftUI ObservableObject", ["@ObservableObject", "@Published"]),
        ("using UIKit ViewController", ["UIViewController"]),
        ("using UIKit TableView", ["UITableView"]),
        ("in Swift", []),
    ],
    "rust": [
        ("using Actix-web", ["actix_web", "#[get("]),
        ("using Axum web framework", ["axum"]),
        ("using Rocket web framework", ["rocket"]),
        ("using Tokio async runtime", ["tokio"]),
        ("using Diesel ORM", ["diesel"]),
        ("using SQLx", ["sqlx"]),
        ("in Rust", []),
    ],
    "go": [
        ("using Gin web framework", ["gin.", "gin.Context"]),
        ("using Fiber web framework", ["fiber."]),
        ("using net/http standard library", ["http.Handler", "http.HandlerFunc"]),
        ("using GORM ORM", ["gorm."]),
        ("using gRPC", ["grpc."]),
        ("in Go", []),
    ],
    "csharp": [
        ("using ASP.NET Core Web API", ["[ApiController]", ": ControllerBase"]),
        ("using ASP.NET MVC Controller", [": Controller"]),
        ("using Entity Framework Core", ["DbContext"]),
        ("in xUnit/NUnit test", ["[Fact]", "[Test]"]),
        ("in C#/.NET", []),
    ],
    "terraform": [("defining Terraform infrastructure (IaC)", [])],
    "config": [
        ("defining Kubernetes manifest", ["apiVersion:"]),
        ("defining Helm chart values", ["helm.sh"]),
        ("defining GitHub Actions workflow", ["github.com/actions", "runs-on:"]),
        ("defining GitLab CI pipeline", ["stages: & script:"]),
        ("defining Docker Compose services", ["docker-compose"]),
        ("in YAML configuration", []),
    ],
}


def _answer(rules: str, content: Column) -> Column:
    """The first answer of a list of rules that a text gives."""
    case = []
    for answer, texts in FRAMEWORKS[rules]:
        said = _answer(answer, content) if answer in FRAMEWORKS else F.lit(answer)
        every = [reduce(lambda a, b: a & b, [F.contains(content, F.lit(part)) for part in text.split(" & ")]) for text in texts]
        case.append(F.when(reduce(lambda a, b: a | b, every), said) if every else said)
    return F.coalesce(*case)


def framework(language: Column, content: Column, metadata: Column | None = None) -> Column:
    """What a symbol is written with, null for a language without rules.

    ``metadata`` (a map) may tell Phoenix by ``framework`` and an umbrella app
    by ``umbrella``, before the text does. A null text gives the language's own answer.
    """
    lang, text = F.lower(language), F.coalesce(content, F.lit(""))
    told = lambda key, value: F.coalesce(F.try_element_at(metadata, F.lit(key)) == value, F.lit(False)) if metadata is not None else F.lit(False)
    elixir = (
        F.when(told("framework", "phoenix"), _answer("phoenix", text)).when(told("umbrella", "true"), "in an Elixir umbrella app")
        .when(F.contains(text, F.lit("use Phoenix")), _answer("phoenix", text)).otherwise(_answer("elixir", text))
    )
    case = F.when(lang == "elixir", elixir).when(lang == "javascript", _answer("typescript", text))
    for name in FRAMEWORKS:
        if name not in ("phoenix", "django", "elixir"):
            case = case.when(lang == name, _answer(name, text))
    return case
